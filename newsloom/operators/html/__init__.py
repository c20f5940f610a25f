"""HTML to articles: a small tree, cleaning, strategies, and their merge in Catalyst."""

from .extract import extract_articles, run_strategies

__all__ = ["extract_articles", "run_strategies"]
