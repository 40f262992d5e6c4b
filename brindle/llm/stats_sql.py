"""Special functions as SQL expression text, for the [native] operators: built from ln and rational terms only."""


def lgamma(x: str) -> str:
    """Stirling's series at x + 8; absolute error below 1e-10 for x > 0."""
    y = f"(({x}) + 8.0D)"
    shift = " * ".join(f"(({x}) + {i}.0D)" for i in range(8))
    series = f"1.0D / (12.0D * {y}) - 1.0D / (360.0D * pow({y}, 3)) + 1.0D / (1260.0D * pow({y}, 5))"
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + {series} - ln({shift}))"


def digamma(x: str) -> str:
    y = f"(({x}) + 6.0D)"
    shift = " + ".join(f"1.0D / (({x}) + {i}.0D)" for i in range(6))
    return f"(ln({y}) - 0.5D / {y} - 1.0D / (12.0D * pow({y}, 2)) + 1.0D / (120.0D * pow({y}, 4)) - 1.0D / (252.0D * pow({y}, 6)) - ({shift}))"


def trigamma(x: str) -> str:
    y = f"(({x}) + 6.0D)"
    shift = " + ".join(f"1.0D / pow(({x}) + {i}.0D, 2)" for i in range(6))
    return f"(1.0D / {y} + 0.5D / pow({y}, 2) + 1.0D / (6.0D * pow({y}, 3)) - 1.0D / (30.0D * pow({y}, 5)) + 1.0D / (42.0D * pow({y}, 7)) + {shift})"


def _stirling_error(x: str) -> str:
    """ln(x!) less Stirling's formula, for x >= 1."""
    near = f"({lgamma(f'{x} + 1')} - (({x}) + 0.5D) * ln({x}) + ({x}) - 0.9189385332046727D)"
    return f"(CASE WHEN {x} < 16 THEN {near} ELSE 1.0D / (12.0D * {x}) - 1.0D / (360.0D * pow({x}, 3)) + 1.0D / (1260.0D * pow({x}, 5)) END)"


def _deviance(x: str, mean: str) -> str:
    """x * ln(x / mean) + mean - x, without loss of digits where x is near mean."""
    off = f"((({x}) - ({mean})) / ({mean}))"
    return f"(({mean}) * ((1.0D + {off}) * log1p({off}) - {off}))"


def binomial_tail(n: str, k: str, rate: float) -> str:
    """P(Bin(n, rate) <= k), exact to about ten digits at any n. From k >= n * rate on, 1 (never significant).

    The greatest term, at k, by its saddle-point form; the terms below follow by their ratios. They fall like a bell of
    deviation sqrt(n * rate * (1 - rate)) at least, so 12 deviations and 200 terms hold all but 1e-20 of the sum, for every n.
    """
    rest = f"({n} - {k})"
    log_top = (
        f"CASE WHEN {k} = 0 THEN {n} * log1p(-{rate}D) ELSE"
        f" {_stirling_error(f'CAST({n} AS DOUBLE)')} - {_stirling_error(f'CAST({k} AS DOUBLE)')} - {_stirling_error(f'CAST({rest} AS DOUBLE)')}"
        f" - {_deviance(k, f'{n} * {rate}D')} - {_deviance(rest, f'{n} * {1 - rate}D')}"
        f" + 0.5D * ln({n} / (6.283185307179586D * {k} * {rest})) END"
    )
    terms = f"least({k}, CAST(12.0D * sqrt({n} * {rate * (1 - rate)}D) AS BIGINT) + 200L)"
    ratio = f"({k} - j) * {(1 - rate) / rate}D / ({n} - {k} + j + 1)"
    total = f"aggregate(sequence(0L, {terms}), named_struct('t', 1.0D, 's', 0.0D), (a, j) -> named_struct('t', a.t * {ratio}, 's', a.s + a.t), a -> a.s)"
    return f"(CASE WHEN {k} >= {n} * {rate}D THEN 1.0D ELSE least(1.0D, exp({log_top}) * {total}) END)"
