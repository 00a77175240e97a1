from contextlib import contextmanager


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plan(df) -> str:
    """The physical plan; the final one where the query has run."""
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **values):
    """Session settings for one block, dots written as two underscores."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
