"""Labels out of file names, slugs and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name patterns of the public datasets; what the group holds is the condition.
CONDITIONS = (
    r"^(CALB_.+)-\d+$",
    r"^(CALCE_[A-Za-z0-9-]+)_\d+$",
    r"^(HNEI_.+)_[a-z]$",
    r"^(MICH_.+)_[a-z]$",
    r"^(SNL_.+)_[a-z]$",
    r"^(UL-PUR_.+)_[a-z]$",
    r"^(HUST)_\d+-\d+$",
    r"^(ISU-ILCC)_[A-Za-z0-9-]+$",
    r"^(MATR)_b\d+c\d+$",
    r"^(NA-ion_.+)_\d+_\d+$",
    r"^(RWTH)_\d+$",
    r"^(SDU_Battery)_\d+$",
    r"^(Stanford_Nova_Regular(?:_Ref)?)_\d+$",
    r"^(Tongji\d+_[^_]+)_.+$",
    r"^(XJTU_[^_]+)_battery-\d+$",
    r"^(ZN-coin_.+)_\d+_Batch-\d+$",
)

# Prefixes of file names, in order, and the datasets that they name.
DATASETS = (
    ("ISU-ILCC", "ISU_ILCC"),
    ("UL-PUR", "UL_PUR"),
    ("NA-ion", "NA-ion"),
    ("ZN-coin", "ZN-coin"),
    ("Stanford_Nova_Regular_Ref", "Stanford"),
    ("Stanford_", "Stanford_2"),
    ("MICH_MCForm", "MICH"),
    ("MICH_", "MICH_EXP"),
    ("Tongji", "Tongji"),
    ("CALB", "CALB"),
    ("CALCE", "CALCE"),
    ("HNEI", "HNEI"),
    ("HUST", "HUST"),
    ("MATR", "MATR"),
    ("RWTH", "RWTH"),
    ("SDU", "SDU"),
    ("SNL", "SNL"),
    ("XJTU", "XJTU"),
)


def name_of(path: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def stem_of(path: Column) -> Column:
    """Name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def condition(path: Column) -> Column:
    """Experiment condition of a file: the first pattern that fits, else the stem without a replicate's token."""
    stem = stem_of(path)
    out = F.when(stem.rlike(r"^.*_([a-z]|[0-9]{1,4}|battery-[0-9]+)$"), F.regexp_replace(stem, r"_[^_]*$", "")).otherwise(stem)
    for pattern in reversed(CONDITIONS):
        out = F.when(stem.rlike(pattern), F.regexp_extract(stem, pattern, 1)).otherwise(out)
    return out


def domain(path: Column) -> Column:
    """Stem before its first underscore; all Tongji sets are one."""
    own = F.substring_index(stem_of(path), "_", 1)
    return F.when(own.startswith("Tongji"), "Tongji").otherwise(own)


def dataset(path: Column, otherwise: Column | None = None) -> Column:
    """Dataset by the first prefix that fits, else `otherwise` (the domain if not given)."""
    name = name_of(path)
    out = domain(path) if otherwise is None else otherwise
    for prefix, label in reversed(DATASETS):
        out = F.when(name.startswith(prefix), label).otherwise(out)
    return out


def slug(text: Column, dots: bool = True, tidy: bool = True, otherwise: str = "item") -> Column:
    """Text as a name for files: runs of other characters become an underscore, none stays at the edges.

    dots: points become p first. tidy: trimmed, underscores in a row are one, lower case, and
    `otherwise` if nothing is left.
    """
    text = F.regexp_replace(text, r"\.", "p") if dots else text
    text = F.regexp_replace(F.trim(text) if tidy else text, r"[^A-Za-z0-9_.-]+", "_")
    text = F.regexp_replace(text, "_+", "_") if tidy else text
    text = F.regexp_replace(text, "^_+|_+$", "")
    return F.coalesce(F.nullif(F.lower(text), F.lit("")), F.lit(otherwise)) if tidy else text


def listed(text: Column, kind: str = "string") -> Column:
    """Items of a comma-separated list, trimmed, blanks left out."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return items if kind == "string" else F.transform(items, lambda x: x.cast(kind))


def reasons(*checks: tuple[Column, Column | str]) -> Column:
    """Texts of the checks that fail, given as (fails, text), joined by `; `; empty if none does. A check that is null does not fail."""
    return F.concat_ws("; ", *(F.when(fails, text if isinstance(text, Column) else F.lit(text)) for fails, text in checks))


def status(why: Column) -> Column:
    """`used` without a reason, `skipped` with one."""
    return F.when(why == "", "used").otherwise("skipped")


def markers_in(texts: list[Column], markers: tuple[str, ...]) -> Column:
    """Sorted list of the markers that some of the texts contain, whatever their case."""
    low = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    held = F.filter(F.array(*map(F.lit, sorted(set(markers)))), lambda m: F.exists(F.array(*low), lambda t: F.contains(t, m)))
    return F.array_join(held, ",")
