"""Training-data operators. Nothing else in the library imports this subpackage."""


def queries() -> dict:
    from sparkseek.llm import registry

    return registry.queries()


def oracle_sql() -> dict:
    from sparkseek.llm import registry

    return registry.oracle_sql()
