"""Mathematical functions."""

from __future__ import annotations

from ..registry import expressions, query

_X = "(p_retailprice / 1000)"
_S = "(p_size / 60.0D)"
_D = "(p_size / 60.0::DOUBLE)"


def _r(name: str, spark: str, duck: str | None = None, digits: int = 8) -> tuple[str, str, str]:
    return name, f"round({spark}, {digits})", f"round({duck or spark}, {digits})"


expressions(
    "fn_trigonometry", "part", "p_partkey",
    [
        _r("acos", f"acos({_S})", f"acos({_D})"), _r("asin", f"asin({_S})", f"asin({_D})"), _r("atan", f"atan({_X})"), _r("atan2", f"atan2({_X}, p_size)"),
        _r("cos", f"cos({_X})"), _r("cosh", f"cosh({_X})"), _r("sin", f"sin({_X})"), _r("sinh", f"sinh({_X})"), _r("tan", f"tan({_S})", f"tan({_D})"), _r("tanh", f"tanh({_X})"),
        _r("degrees", f"degrees({_X})", digits=6), _r("radians", f"radians({_X})"),
    ],
)
expressions(
    "fn_exponents_logs", "part", "p_partkey",
    [
        _r("cbrt", "cbrt(p_retailprice)"), _r("exp", f"exp({_X})", digits=6), _r("expm1", f"expm1({_X})", f"exp({_X}) - 1", 6), _r("ln", "ln(p_retailprice)"), _r("log", "log(p_retailprice)", "ln(p_retailprice)"),
        _r("log_base", "log(2, p_retailprice)", "log2(p_retailprice)"), _r("log10", "log10(p_retailprice)"), _r("log1p", f"log1p({_X})", f"ln(1 + {_X})"), _r("log2", "log2(p_retailprice)"),
        _r("pow", "pow(p_size, 2)"), _r("power", f"power({_X}, 1.5)", digits=6), _r("sqrt", "sqrt(p_retailprice)"), _r("hypot", f"hypot({_X}, p_size)", f"sqrt({_X} * {_X} + p_size * p_size)"),
        ("e", "round(e(), 10)", "round(exp(1.0), 10)"), ("pi", "round(pi(), 10)"),
    ],
)
expressions(
    "fn_rounding_signs", "customer", "c_custkey",
    [
        ("abs", "abs(c_acctbal)"), ("ceil", "ceil(c_acctbal)", "ceil(c_acctbal)::BIGINT"), ("ceiling", "ceiling(c_acctbal)", "ceil(c_acctbal)::BIGINT"), ("floor", "floor(c_acctbal)", "floor(c_acctbal)::BIGINT"),
        ("rint", "rint(c_acctbal)", "round_even(c_acctbal, 0)"), ("round1", "round(c_acctbal / 7, 3)"), ("round0", "round(c_acctbal)", "round(c_acctbal)"), ("bround", "bround(c_custkey / 2.0D, 0)", "round_even(c_custkey / 2.0::DOUBLE, 0)"),
        ("negative", "negative(c_custkey)", "-c_custkey"), ("positive", "positive(c_custkey)", "c_custkey"), ("sign", "sign(c_acctbal)", "sign(c_acctbal)::DOUBLE"), ("signum", "signum(c_acctbal)", "sign(c_acctbal)::DOUBLE"),
        ("greatest", "greatest(c_custkey, 700)"), ("least", "least(c_custkey, 700)"),
    ],
)
expressions(
    "fn_integers", "orders", "o_orderkey",
    [
        ("pmod", "pmod(-o_orderkey, 7)", "((-o_orderkey % 7) + 7) % 7"), ("remainder", "o_orderkey % 7"), ("divided", "o_orderkey div 7", "o_orderkey // 7"), ("shiftleft", "shiftleft(o_orderkey, 2)", "o_orderkey << 2"),
        ("shiftright", "shiftright(o_orderkey, 1)", "o_orderkey >> 1"), ("shiftrightunsigned", "shiftrightunsigned(o_orderkey, 2)", "o_orderkey >> 2"), ("bin", "bin(o_orderkey)", "bin(o_orderkey)"),
        ("hex", "hex(o_orderkey)", "hex(o_orderkey)"), ("unhex", "CAST(unhex(hex('ab')) AS STRING)", "'ab'"), ("conv", "conv(CAST(o_orderkey AS STRING), 10, 16)", "hex(o_orderkey)"),
        ("factorial", "factorial(CAST(o_orderkey % 10 AS INT))", "factorial((o_orderkey % 10)::INT)::BIGINT"), ("quotient", "round(o_orderkey / 4, 4)", "round(o_orderkey / 4, 4)"),
    ],
)


@query("fn_random", "SELECT count(*) AS n, true AS in_range, true AS centred FROM orders")
def fn_random(t):
    """rand and randn are checked by range and mean: their streams depend on the partitioning."""
    return t.sql("SELECT count(*) AS n, min(r) >= 0 AND max(r) < 1 AS in_range, abs(avg(g)) < 0.1 AS centred FROM (SELECT rand(1) AS r, randn(2) AS g FROM orders)")
