"""The registered queries of the package's own operators."""

from __future__ import annotations

from collections.abc import Callable

from seqmill.session import ship


def queries() -> dict[str, Callable]:
    from seqmill.plans import corpora, logs, rhythm, scores, sounds, tracks  # noqa: F401
    from seqmill.plans.registry import QUERIES

    def shipped(f: Callable) -> Callable:
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}


def oracles() -> dict[str, str]:
    from seqmill.plans import corpora, logs, rhythm, scores, sounds, tracks  # noqa: F401
    from seqmill.plans.registry import ORACLES

    return dict(ORACLES)
