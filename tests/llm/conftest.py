import random

import pytest

from foldwise.llm import registry

registry.load()

# Names that the operators use inside; as columns of the input they must not disturb.
CLASHING = ["row", "key", "id", "n", "words", "drops", "shard", "slot", "path", "u", "topic", "weight", "doc", "head", "rejected_by", "__by", "__text", "n_words", "label", "line"]


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(r.choice("bdfglmnprst") + r.choice("aeiou") + r.choice("bdfglmnprst") + r.choice(["", "en", "or", "is"]) + str(r.randrange(vocabulary)) for _ in range(n))


def odd_documents():
    """Ids and texts with every case that operators have to take."""
    long = prose(1, 60_000)
    near = prose(2, 200).split()
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, "two  words"), (6, "two\twords"), (7, prose(3, 60)), (7, prose(3, 60)), (7, prose(4, 60)),
        (None, prose(5, 80)), (None, prose(5, 80)), (None, None), (8, long), (9, " ".join(near)), (10, " ".join([*near[:100], "changed", *near[101:]])),
        (11, "\n".join([prose(6, 20), "This page was made by station 12 of the old northern line", prose(7, 30)])),
        (12, "\n".join([prose(8, 25), "This page was made by station 57 of the old northern line", prose(9, 30)])),
        (13, "### %%% &&& " * 40), (14, "same words again and again " * 30), (15, "été Σίσυφος 日本語 <|endoftext|> don't x\x1cy"), (16, "💥" * 30), (17, "a" * 5000),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, len(t or "")) + tuple(range(len(CLASHING))) for k, (i, t) in enumerate(odd_documents())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """The documents of the small tables, by id."""
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
