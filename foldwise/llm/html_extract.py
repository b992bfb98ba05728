"""Main text of web pages, by paths that the pages of a host agree on.

Each page scores its containers, widens the best to the ancestor that has all of the
article, and names its generalised tag-class path.  Spark counts these votes per host,
folded in every task first, so a host of any size moves a few rows only.  Every page is
then read again with the paths its host has voted for.  A page whose own path others of
its host have too follows that template; any other one takes the path of most pages, or,
where that holds less than ``OWN_TEMPLATE`` of its best container's text, its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import html_page
from foldwise.llm.common import materialise, table
from foldwise.llm.registry import query

OWN_TEMPLATE = 0.6  # below this share of its own best container's text, a page does not follow its host

TEMPLATE_VOTES, TEMPLATE_SHARE = 2, 0.01  # a host's path with so many votes, and this share of them, is a template of its own


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null without one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: Counter = Counter()

    def counted() -> pa.RecordBatch:
        rows = [(*k, v) for k, v in votes.items()]
        votes.clear()
        return pa.record_batch({
            "host": pa.array([r[0] for r in rows], pa.string()), "path": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            path = html_page.best_path(html_page.blocks(source.as_py()))
            if path is not None:
                votes[host, path] += 1
        if len(votes) > 20_000:
            yield counted()
    yield counted()


def _host_votes(pages: DataFrame, url: str, html: str) -> DataFrame:
    known = pages.select(host_of(F.col(url)).alias("host"), F.col(html)).where(f"host IS NOT NULL AND `{html}` IS NOT NULL")
    return known.mapInArrow(_votes, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("votes"))


def _most_voted(votes: DataFrame) -> DataFrame:
    first = F.min_by("path", F.struct(-F.col("votes"), F.col("path")))
    return votes.groupBy("host").agg(first.alias("path"), F.max("votes").alias("votes"), F.sum("votes").alias("pages"))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, votes``: for each host the path most of its pages name, the first in order of equals."""
    return _most_voted(_host_votes(pages, url, html)).drop("pages")


def host_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, paths``: the path of most pages, and all that count as templates, at most 1 / ``TEMPLATE_SHARE``."""
    votes = materialise(_host_votes(pages, url, html))
    most = materialise(_most_voted(votes))
    several = votes.where(F.col("votes") >= TEMPLATE_VOTES).join(most.select("host", "pages"), "host")
    several = several.where(F.col("votes") >= TEMPLATE_SHARE * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return most.select("host", "path").join(several, "host", "left")


def page_text(source: str | None, path: str | None, paths: Collection[str] = ()) -> str:
    """Text of one page under its own path if it is one of its host's templates, else under its host's path if that fits."""
    found = html_page.blocks(source or "")
    core = html_page.best(found)
    if core is None:
        return ""
    own = html_page.widened(found, core).path
    if path is not None and path != own and own not in paths:
        kept = html_page.text_below(found, path)
        alone = html_page.text_below(found, core.path)
        if sum(map(len, kept)) >= OWN_TEMPLATE * sum(map(len, alone)):
            return "\n\n".join(kept)
    return "\n\n".join(html_page.text_below(found, own))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html, path, paths = batch.column("__html"), batch.column("__path").to_pylist(), batch.column("__paths")
        for a in range(0, batch.num_rows, 256):
            some = batch.slice(a, 256)
            texts = [page_text(h.as_py(), p, ps.as_py() or ()) for h, p, ps in zip(html.slice(a, 256), path[a : a + 256], paths.slice(a, 256), strict=True)]
            yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``row`` (the page without its html) and ``text``, its main text.

    Defined cases: a null or empty html gives an empty text, as does a page without
    any text outside menus and the like; a null URL or one without a host leaves a page
    to its own best container; repeated rows each give their text; extra columns
    stay inside ``row``; an empty table gives an empty result.
    """
    paths = materialise(host_templates(pages, url, html)).select(F.col("host").alias("__voted"), F.col("path").alias("__path"), F.col("paths").alias("__paths"))
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html])
    packed = pages.select(own.alias("row"), F.col(html).alias("__html"), host_of(F.col(url)).alias("__host"))
    # The table of paths is written, so its size is known: it is sent to all tasks only if small.
    joined = packed.join(paths, F.col("__host") == F.col("__voted"), "left").select("row", "__html", "__path", "__paths")
    return joined.mapInArrow(_texts, packed.select("row").limit(0).withColumn("text", F.lit("")).schema)


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
