"""Order-insensitive comparison of a Spark result with an oracle result."""


def canonical(frame):
    """Column names and rows as sorted text, columns in name order."""
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted([tuple(repr(float(v) + 0.0) if isinstance(v, float) else repr(v) for v in row) for row in rows])


def frame_of(df):
    """A Spark result as a pandas frame whose whole numbers stay whole beside nulls."""
    frame = df.toPandas()
    for f in df.schema:
        if f.dataType.simpleString() in ("int", "bigint") and frame[f.name].dtype.kind == "f":
            frame[f.name] = frame[f.name].astype("Int64")
    return frame


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def type_gaps(df, db, sql):
    """Columns whose Spark and oracle types differ."""
    want = {d[0]: str(d[1]) for d in db.execute(sql).description}
    return {f.name: (f.dataType.simpleString(), want.get(f.name)) for f in df.schema if KINDS.get(f.dataType.simpleString()) != want.get(f.name)}
