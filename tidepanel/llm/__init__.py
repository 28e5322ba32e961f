"""Training-data operators. ``load_all`` fills ``registry.QUERIES`` and ``registry.ORACLES``."""


def load_all() -> None:
    from tidepanel.llm import queries  # noqa: F401
