"""Normalisers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions import fixed
from gleaner.functions.common import WORD, WS, col, collapse, let, strip


def normalize_email(c: Column | str) -> Column:
    """Trimmed lower-case address without trailing dots, '' if it is not an address."""
    return let(
        F.regexp_replace(F.lower(strip(c)), r"\.+$", ""),
        lambda e: F.when(e.rlike(rf"^[{WORD}.-]+@[{WORD}.-]+\.[{WORD}]+$"), e).otherwise(F.lit("")),
    )


@F.pandas_udf(StringType())
def _decompose(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKD")


def normalize_business_name(c: Column | str, ascii_only: bool = False) -> Column:
    """Trimmed, decomposed (NFKD), without special characters, in title case.

    Decomposition needs Unicode tables Spark has no function for, so it runs as a vectorised UDF.
    ``ascii_only`` leaves it out, for inputs where it changes nothing.
    """
    name = strip(c)
    if not ascii_only:
        # names in ASCII are their own decomposition; Python gets NULL for them
        name = F.coalesce(_decompose(F.when(F.length(name) != F.octet_length(name), name)), name)
    kept = F.regexp_replace(name, rf"[^{WORD}{WS}&-]", "")
    # a capital follows anything that is not a letter
    pieces = F.regexp_extract_all(kept, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))),
        ),
        "",
    )


def normalize_address(c: Column | str) -> Column:
    return collapse(c)


def normalize_currency(c: Column | str) -> Column:
    """First number in the text, thousands separators removed; 0.0 if there is none."""
    pattern = rf"(\$|USD|EUR|GBP|INR|CAD|AUD)?[{WS}]?([0-9,.]+)"
    digits = F.replace(F.regexp_extract(col(c), pattern, 2), F.lit(","), F.lit(""))
    return F.coalesce(F.when(digits.rlike(r"^[0-9.]+$"), digits.try_cast("double")), F.lit(0.0))


# fixed value: date forms in the order they are tried (day before month)
DATE_FORMS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"(?i)^[a-z]{3} \d{1,2}, \d{4}$", "MMM d, y"),
    (r"(?i)^[a-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, y"),
]


def normalize_date(c: Column | str) -> Column:
    """ISO date-time of the first form that fits, NULL if none does."""
    # month names are matched in any case; Spark wants them capitalised
    text = F.initcap(strip(c))
    parsed = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))) for shape, form in DATE_FORMS]
    return F.date_format(F.coalesce(*parsed), "yyyy-MM-dd'T'HH:mm:ss")


def normalize_phone(
    c: Column | str,
    default_region: str = fixed.DEFAULT_REGION,
    regions: Sequence[tuple] = fixed.PHONE_REGIONS,
) -> Column:
    """E.164 form of a phone number, '' if no numbering plan accepts it.

    Tried in this order: international form; ten digits as a number of the default region; any
    form of the default region (trunk prefix, international prefix 00, calling code without plus).
    The plans are a small fixed table, so they become literals in the plan and no join is needed;
    no calling code is the prefix of another, so at most one matches. Countries without a plan of their
    own are held against the assigned calling codes and the lengths that E.164 allows.
    """
    by_code = F.create_map(
        *[x for r in regions for x in (
            F.lit(r[1]),
            F.struct(F.lit(r[1]).alias("code"), F.lit(r[2]).alias("trunk"), F.lit(r[3]).alias("lo"),
                     F.lit(r[4]).alias("hi"), F.lit(f"^[{r[5]}]").alias("lead")),
        )]
    )
    home = next(r for r in regions if r[0] == default_region)
    phone = strip(c)

    def valid(plan: Column, number: Column) -> Column:
        return F.length(number).between(plan["lo"], plan["hi"]) & F.regexp_like(number, plan["lead"])

    def international(digits: Column) -> Column:
        plan = F.coalesce(*[F.try_element_at(by_code, F.substring(digits, 1, n)) for n in (3, 2, 1)])
        rest = F.length(digits) - F.length(F.regexp_extract(digits, fixed.CALLING_CODES, 0))
        assigned = digits.rlike(fixed.CALLING_CODES) & rest.between(*fixed.NATIONAL_DIGITS) & (F.length(digits) <= 15)
        return let(
            plan,
            lambda p: F.when(p.isNull(), F.when(assigned, F.concat(F.lit("+"), digits))).otherwise(let(
                F.substr(digits, F.length(p["code"]) + 1),
                lambda n: F.when(valid(p, n), F.concat(F.lit("+"), digits)),
            )),
        )

    def national(digits: Column) -> Column:
        _, code, trunk, lo, hi, lead = home

        def fits(n: Column) -> Column:
            return F.when(
                F.length(n).between(lo, hi) & n.rlike(f"^[{lead}]"), F.concat(F.lit("+" + code), n)
            )

        tries = [fits(digits)]
        if trunk:
            tries.append(F.when(digits.startswith(trunk), fits(F.substr(digits, F.lit(len(trunk) + 1)))))
        tries.append(F.when(digits.startswith(code), fits(F.substr(digits, F.lit(len(code) + 1)))))
        return F.coalesce(*tries)

    def cascade(digits: Column) -> Column:
        return F.coalesce(
            F.when(phone.startswith("+"), international(digits)),
            F.when(F.length(digits) == 10, national(digits)),
            F.when(digits.startswith("00"), international(F.substr(digits, F.lit(3)))),
            national(digits),
            F.lit(""),
        )

    return let(F.regexp_replace(phone, r"[^0-9]", ""), cascade)
