"""Distance metrics between two feature lists, as SQL text that Spark and DuckDB share.

Each metric gives the distance; ``euclidean_sq`` its square, which nearest-neighbour
search orders by so that no root is taken inside a join.
"""

from __future__ import annotations


def _plus(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _guarded(num: str, den: str) -> str:
    """0 where both vanish: ANSI division by zero raises."""
    return f"(CASE WHEN {den} = 0e0 THEN 0e0 ELSE {num} / {den} END)"


def _pairs(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    return list(zip(a, b, strict=True))


def euclidean_sq(a: list[str], b: list[str]) -> str:
    return _plus([f"({x} - {y}) * ({x} - {y})" for x, y in _pairs(a, b)])


def manhattan(a: list[str], b: list[str]) -> str:
    return _plus([f"abs({x} - {y})" for x, y in _pairs(a, b)])


def chebyshev(a: list[str], b: list[str]) -> str:
    terms = [f"abs({x} - {y})" for x, y in _pairs(a, b)]
    return terms[0] if len(terms) == 1 else f"greatest({', '.join(terms)})"


def canberra(a: list[str], b: list[str]) -> str:
    return _plus([_guarded(f"abs({x} - {y})", f"(abs({x}) + abs({y}))") for x, y in _pairs(a, b)])


def braycurtis(a: list[str], b: list[str]) -> str:
    return _guarded(manhattan(a, b), _plus([f"abs({x} + {y})" for x, y in _pairs(a, b)]))


def hamming(a: list[str], b: list[str]) -> str:
    return _plus([f"(CASE WHEN {x} <> {y} THEN 1e0 ELSE 0e0 END)" for x, y in _pairs(a, b)]) + f" / {len(a)}e0"


def cosine(a: list[str], b: list[str]) -> str:
    dot = _plus([f"{x} * {y}" for x, y in _pairs(a, b)])
    norm = " * ".join(f"sqrt({_plus([f'{x} * {x}' for x in side])})" for side in (a, b))
    return f"(1e0 - {_guarded(dot, f'({norm})')})"


#: By name; the squared Euclidean distance is not a metric, hence not listed.
METRICS = {
    "euclidean": lambda a, b: f"sqrt({euclidean_sq(a, b)})",
    "manhattan": manhattan, "cityblock": manhattan, "l1": manhattan,
    "chebyshev": chebyshev, "canberra": canberra, "braycurtis": braycurtis,
    "hamming": hamming, "cosine": cosine,
}


def distance_sql(metric: str, a: list[str], b: list[str]) -> str:
    """SQL text of the named metric; KeyError for an unknown one."""
    return METRICS[metric](a, b)
