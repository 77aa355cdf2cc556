"""A decorator that collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from docketflow.sources.adapter import view, with_views


class Register:
    """``@register("views it reads", "SQL twin")`` on a function of those views' DataFrames."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, views: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            def run(spark, sf_dir, f=f):
                return f(*[view(spark, sf_dir, v) for v in views.split()])

            self.queries[f.__name__] = run
            if sql:
                self.oracle[f.__name__] = with_views(views, sql)
            return f

        return add
