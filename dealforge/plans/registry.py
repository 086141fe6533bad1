"""Name -> query and name -> SQL registries filled by the plan modules."""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name, sql=None):
    """Register a query ``f(spark, sf_dir)`` and, if given, its SQL twin."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
