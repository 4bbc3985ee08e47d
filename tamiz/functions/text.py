"""Text expressions: key normalisation, accents, labels, safe parsing."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

# Accented letters (both cases) and the lower-case letter each becomes.
ACCENTED = "áÁéÉíÍóÓúÚñÑ"
UNACCENTED = "aaeeiioouunn"


def norm_key(c: Column) -> Column:
    """Join key of an identifier: trimmed, upper case."""
    return F.upper(F.trim(c))


def strip_accents(c: Column) -> Column:
    """Spanish accents to plain lower-case letters."""
    return F.translate(c, ACCENTED, UNACCENTED)


def capitalise_first(c: Column) -> Column:
    """First letter upper, everything after it lower (unlike ``initcap``)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def capitalise_label(c: Column) -> Column:
    """First letter upper, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def composite_key(*parts: Column) -> Column:
    """``a_b`` key in which a missing part reads ``NA``."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def file_base_name(c: Column) -> Column:
    """File name without its folders."""
    return F.regexp_replace(c, ".*/", "")


def year_in_name(c: Column, pattern: str = "20(22|23|24)") -> Column:
    """First year found in a file name, empty text when there is none."""
    return F.regexp_extract(c, pattern, 0)


def prefix_of_name(c: Column) -> Column:
    """Text before the first underscore."""
    return F.regexp_extract(c, "^[^_]+", 0)


def semester_in_name(c: Column) -> Column:
    """``YYYY-I`` or ``YYYY-II`` at the end of a workbook name, null when absent."""
    return F.nullif(F.regexp_extract(c, r"_(\d{4}-I{1,2})\.[^.]+$", 1), F.lit(""))


def joined_counts(values: Column, order: Column) -> Column:
    """Aggregate: the values in ``order``, as comma-separated text."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"].cast("string")), ", ")


def snake_names(names: list[str]) -> list[str]:
    """Column names as lower-case words joined by underscores; repeated names get a number."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain)
        base = re.sub(r"[^0-9a-zA-Z]+", "_", plain).strip("_").lower() or "x"
        if base[0].isdigit():
            base = "x" + base
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def spaced_names(names: list[str]) -> list[str]:
    """Underscores to spaces, for report headings."""
    return [n.replace("_", " ") for n in names]
