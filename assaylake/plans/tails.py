"""SQL for the tails of distributions, by series of positive terms."""


def beta(x: str, a: str, b: str) -> str:
    """The regularised incomplete beta function."""

    def part(x: str, a: str, b: str) -> str:
        return f"(exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) * list_sum(list_transform(range(0, 400), lambda i: exp(i * ln({x}) + lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1)))))"

    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} < 0.5 THEN {part(x, a, b)} ELSE 1 - {part(f'(1 - {x})', b, a)} END"


def t(t: str, df: str) -> str:
    return f"CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN {beta(f'({df} / ({df} + {t} * {t}))', f'({df} / 2.0)', '0.5')} END"


def f(f: str, one: str, two: str) -> str:
    return f"CASE WHEN {f} IS NOT NULL AND {one} > 0 AND {two} > 0 THEN {beta(f'({two} / ({two} + {one} * {f}))', f'({two} / 2.0)', f'({one} / 2.0)')} END"


def chi(x: str, df: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {df} <= 0 THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 800), lambda i: exp(({df} / 2.0 + i) * ln({x} / 2.0) - {x} / 2.0 - lgamma({df} / 2.0 + i + 1))))) END"


def z(z: str) -> str:
    return chi(f"({z} * {z})", "1")


def kolmogorov(x: str) -> str:
    return f"CASE WHEN {x} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 121), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * {x} * {x}))))) END"


def rounded(columns: dict[str, str], rows: str) -> str:
    """Of rows, columns by name: as they are for a name alone, else the expression, to six places."""
    return "SELECT " + ", ".join(c if not e else f"round({e}, 6) + 0.0 AS {c}" for c, e in columns.items()) + f" FROM ({rows})"
