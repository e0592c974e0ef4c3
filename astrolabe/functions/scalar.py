"""Scalar Column builders (F6-F24).  JVM-side expressions only, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


# ---- F6-F9: rate laws ------------------------------------------------------

# Rate-law constants (reference temperature in K; the two
# ion-polar formulas' coefficients).
T_REF = 300.0
IONPOL1_CONST, IONPOL1_COEF = 0.62, 0.4767
IONPOL2_COEF, IONPOL2_DIV = 0.0967, 10.526


def arrhenius_rate(T, alpha, beta, gamma) -> Column:
    """alpha * (T/T_REF)^beta * exp(-gamma/T)."""
    T, a, b, g = map(_c, (T, alpha, beta, gamma))
    return a * F.pow(T / T_REF, b) * F.exp(-g / T)


def ionpol1(T, alpha, beta, gamma) -> Column:
    """alpha*beta*(IONPOL1_CONST + IONPOL1_COEF*gamma*sqrt(T_REF/T))."""
    T, a, b, g = map(_c, (T, alpha, beta, gamma))
    return a * b * (IONPOL1_CONST + IONPOL1_COEF * g * F.sqrt(T_REF / T))


def ionpol2(T, alpha, beta, gamma) -> Column:
    """F8: alpha*beta*(1 + IONPOL2_COEF*gamma*sqrt(T_REF/T) + gamma^2/IONPOL2_DIV * T_REF/T)."""
    T, a, b, g = map(_c, (T, alpha, beta, gamma))
    return a * b * (1.0 + IONPOL2_COEF * g * F.sqrt(T_REF / T) + (g * g / IONPOL2_DIV) * (T_REF / T))


def compute_rate(react_class, T, alpha, beta, gamma, lenient: bool = False) -> Column:
    """dispatch on the reaction class (3, 4, 5).

    Any other class, or none, is an error (``raise_error``), and NULL on request
    (``lenient``).
    """
    cls = _c(react_class)
    other = (F.lit(None).cast("double") if lenient
             else F.raise_error(F.concat(F.lit("reaction class not recognised: "),
                                         F.coalesce(cls.cast("string"), F.lit("none")))).cast("double"))
    return (F.when(cls == 3, arrhenius_rate(T, alpha, beta, gamma))
            .when(cls == 4, ionpol1(T, alpha, beta, gamma))
            .when(cls == 5, ionpol2(T, alpha, beta, gamma))
            .otherwise(other))


def temperature_grid(lo: float = 2.0, hi: float = 300.0, n: int = 100) -> Column:
    """``n`` evenly spaced temperatures, inclusive (like linspace), exploded per row."""
    step = (hi - lo) / (n - 1)
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                 lambda i: F.lit(lo) + i * F.lit(step)))


# ---- F11-F13, F20: numeric transforms ----------------------------------------

def log10_pos(x) -> Column:
    """log10 for x > 0, NULL otherwise (no -inf / NaN)."""
    x = _c(x)
    return F.when(x > 0, F.log10(x))


def exp10(x) -> Column:
    return F.pow(F.lit(10.0), _c(x))


def error_factor(pred, obs) -> Column:
    """10 ** |log10(pred/obs)| (symmetric multiplicative error)."""
    return exp10(F.abs(log10_pos(F.try_divide(_c(pred), _c(obs)))))


def acquisition_product(mean, std) -> Column:
    """mean * std."""
    return _c(mean) * _c(std)


def acquisition_ratio(mean, std) -> Column:
    """10**mean / 10**std."""
    return F.try_divide(exp10(mean), exp10(std))


# ---- F14-F19: formula strings ----------------------------------------------------

# Standard atomic weights of the elements that formulas here use.
ATOMIC_MASS = {
    "H": 1.00794, "C": 12.0107, "N": 14.0067, "O": 15.9994,
    "Si": 28.0855, "P": 30.973762, "S": 32.065,
}

# Elements counted as heavy atoms by the formula counter.
HEAVY_ELEMENTS = ["N", "O", "Si", "P", "S"]


def element_count(formula, element: str) -> Column:
    """atom count of ``element`` from the last ``<El><digits>`` token.

    Absent → 0, bare symbol → 1, symbol with digits → that number (all of its
    digits; NULL beyond the integer range).  Like the original rule, the pattern is a plain prefix match (``S`` also sees ``Si``).
    """
    toks = F.regexp_extract_all(_c(formula), F.lit(element + r"\d*"), 0)
    last = F.element_at(toks, -1)
    digits = F.regexp_replace(last, element, "")
    return (F.when(F.size(toks) == 0, F.lit(0))
            .when(digits == "", F.lit(1))
            .otherwise(digits.try_cast("int")))


def heavy_atom_count(formula) -> Column:
    total = F.lit(0)
    for el in HEAVY_ELEMENTS:
        total = total + element_count(formula, el)
    return total


def strip_charges(s) -> Column:
    """F16: remove '+' and '-'."""
    return F.translate(_c(s), "+-", "")


def formula_markup(s) -> Column:
    """digit runs → ``$_{n}$``; charge suffixes → ``$^c$``."""
    t = F.regexp_replace(_c(s), r"(\d+)", "\\$_{$1}\\$")
    return F.regexp_replace(t, r"([+-])", "\\$^$1\\$")


def escape_wrap(s, char: str = "#", prefix: str = "\\ce{", suffix: str = "}") -> Column:
    """escape one character with a backslash and wrap in a template."""
    return F.concat(F.lit(prefix), F.replace(_c(s), F.lit(char), F.lit("\\" + char)), F.lit(suffix))


def multiplicity(n_radical) -> Column:
    """2 * (n/2) + 1."""
    return 2 * (_c(n_radical) / 2.0) + 1


def scf_reference(mult) -> Column:
    """'rhf' for singlets, 'uhf' otherwise."""
    return F.when(_c(mult) == 1, F.lit("rhf")).otherwise(F.lit("uhf"))


# ---- F23-F24: string features, normalised key ---------------------------------

#: Character classes of the string features: ring digits, branches, bond symbols, upper-case and lower-case letters.
FEATURE_CLASSES = {"digits": r"[0-9]", "branches": r"\(", "bonds": r"[=#]", "upper": r"[A-Z]", "lower": r"[a-z]"}


def string_features(s) -> Column:
    """F23 (re-aimed): length, the counts of ``FEATURE_CLASSES`` in order, and their shares of the length (0 for an empty string)."""
    s = _c(s)
    size = F.length(s).cast("double")
    counts = [F.regexp_count(s, F.lit(c)).cast("double") for c in FEATURE_CLASSES.values()]
    return F.array(size, *counts, *[F.when(size > 0, n / size).otherwise(F.when(size.isNotNull(), 0.0)) for n in counts])


def normalise_key(s) -> Column:
    """F24 (re-aimed): one spelling per item — collapse whitespace, trim,
    lower-case; empty → NULL."""
    t = F.lower(F.trim(F.regexp_replace(_c(s), r"[ \t\r\n]+", " ")))
    return F.when(t != "", t)


def round6(x, digits: int = 6) -> Column:
    """Round a double to ``digits`` decimals by scaling, rounding half away from
    zero, and unscaling — the same arithmetic as SQL engines that round the
    binary value (Spark's own ``round`` on doubles goes through the shortest
    decimal string, which decides exact-looking ties differently)."""
    m = 10.0 ** digits
    return F.round(_c(x) * F.lit(m), 0) / F.lit(m)
