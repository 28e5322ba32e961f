"""Registered queries over the star tables."""


def load_all() -> None:
    """Import every query module, which fills the registry."""
    from tidepanel.plans import audit_queries, book_queries, panel_queries, regime_queries, selection_queries, signal_queries, source_queries, trial_queries  # noqa: F401
