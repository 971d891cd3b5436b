"""Registration of queries with their SQL counterparts."""

from checks.views import use
from sward.session import tune

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function of the session; the table folder is chosen before it runs."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark, sf_dir):
            use(tune(spark), sf_dir)
            return fn(spark)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
