"""Numbers, dates and names as published in French, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and their plain forms, French month names, member
# countries with their two-letter suffixes.
ACCENTED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
COUNTRIES = {"ci": "cote d ivoire", "sn": "senegal", "bf": "burkina faso", "bj": "benin", "ml": "mali", "ne": "niger", "tg": "togo"}


def plain(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalised(c: Column) -> Column:
    """Without accents, other than letters and digits as single spaces, lower case."""
    return F.trim(F.regexp_replace(F.lower(plain(c)), "[^a-z0-9]+", " "))


def number(c: Column) -> Column:
    """A French number: spaces dropped, comma as decimal sign, dots as thousands only beside a comma."""
    bare = F.regexp_replace(c, "[^0-9,.\\-]", "")
    sign = F.when(bare.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(bare, "-", "")
    digits = F.when(digits.contains(","), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(digits)
    return F.when(digits != "", F.concat(sign, digits).try_cast("double"))


def day(c: Column) -> Column:
    """A date in any of the published notations, else null."""
    text = F.trim(c)
    tried = [F.try_to_date(text, f) for f in ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d.M.yyyy", "d/M/yy")]
    words = F.regexp_extract(F.lower(plain(text)), "([0-9]{1,2})(?:er)?\\s+([a-z]+),?\\s+([0-9]{4})", 0)
    part = lambda i: F.regexp_extract(words, "([0-9]{1,2})(?:er)?\\s+([a-z]+),?\\s+([0-9]{4})", i)
    month = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    spelled = F.concat_ws("-", part(3), F.lpad(F.try_element_at(month, part(2)).cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.coalesce(*tried, F.when(F.length(spelled) == 10, spelled.try_cast("date")))


def session_stamp(c: Column) -> tuple[Column, Column]:
    """Date and hour (as HH:mm) out of a "last update" sentence; null where it holds none."""
    text = F.lower(plain(c))
    date = F.coalesce(day(F.regexp_extract(text, "([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})", 1)), day(F.regexp_extract(text, "([0-9]{1,2}(?:er)?\\s+[a-z]+,?\\s+[0-9]{4})", 1)))
    hour, minute = F.regexp_extract(text, "([0-9]{1,2})\\s*[h:]\\s*([0-9]{2})", 1), F.regexp_extract(text, "([0-9]{1,2})\\s*[h:]\\s*([0-9]{2})", 2)
    return date, F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def without_country(name: Column) -> Column:
    """A normalised company name without its country suffix, code or full name."""
    ends = "|".join([*COUNTRIES.values(), *COUNTRIES])
    return F.regexp_replace(normalised(name), f"\\s+({ends})$", "")


def fiscal_year(c: Column) -> Column:
    """A year out of "2015", "2015.0" or a text that begins with one."""
    return F.coalesce(c.try_cast("double").cast("int"), F.substring(c, 1, 4).try_cast("int"))


def ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def is_ticker(c: Column) -> Column:
    return c.rlike("^[A-Z]{2,6}$")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))
