"""The place at the right end of a line: country, region and city, by joins with a gazetteer.

A line is cut into clauses, and a clause into words.  Every run of a few words near a clause's end
is looked up at once, by one join on its normal form; what the runs can mean together is a join of
runs that stand side by side: a city before a region before a country.  All readings that hold are
kept until the last step, where one is chosen, so that a wrong first guess cannot hide a right one.

The gazetteer (kind, name, cc, region, label, sure, city, population) is a table:

- ``country``: cc and label; ``sure`` unless a city must vouch for it;
- ``region``: cc, region code and label; ``sure`` unless a city must vouch for it; ``city`` where the name says both;
- ``city``: cc, region code and population; a label only where it is to be shown in place of the name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.dates import date_mentions
from cadenza.operators.dated import LATEST
from cadenza.sources.catalogue import Catalogue

GAZETTEER = "kind string, name string, cc string, region string, label string, sure boolean, city string, population long"
#: Words of a name at most, words of a city that no table knows, and the inhabitants of a city that stands for itself.
LONGEST, LONGEST_CITY, LARGE = 4, 5, 50_000
#: Words before which a known city's name goes on ("East Hempstead").
MODIFIERS = "east west north south new old upper lower great little port fort mount saint san santa los las".split()
_CLAUSE = r"\s+[@|/\-–—]\s+|;"


def normal(text: Column) -> Column:
    """Lower case without accents, dots and brackets; St, Ft and Mt in full."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿœ’", "aaaaaaceeeeiiiinoooooouuuuyyo'")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[.()'\[\]]", ""), r"[^a-z0-9]+", " "))
    for short, long in (("st", "saint"), ("ft", "fort"), ("mt", "mount")):
        plain = F.regexp_replace(plain, rf"\b{short}\b", long)
    return plain


def _blanked(lines: DataFrame) -> DataFrame:
    """line, and text: the line with its dates blank."""
    found = date_mentions(lines, "line", "line", LATEST)
    found = found.groupBy("line").agg(F.collect_list(F.struct("start", "end")).alias("dates"))
    blank = F.aggregate(
        F.col("dates"), F.col("line"), lambda t, d: F.concat(F.substring(t, F.lit(1), d["start"]), F.repeat(F.lit(" "), d["end"] - d["start"]), F.substring(t, d["end"] + 1, F.length(t)))
    )
    return lines.join(found, "line", "left").select("line", F.coalesce(blank, F.col("line")).alias("text"))


def _runs(lines: DataFrame) -> DataFrame:
    """line, text, clause, a, b (first word and the one after the last), run, name, and the clause's words: runs that do not cross a comma."""
    rows = lines.select("line", "text", F.posexplode(F.split("text", _CLAUSE)).alias("clause", "body"))
    rows = rows.select("line", "text", "clause", F.explode(F.array(_words(F.col("body")))).alias("words")).filter("size(words) > 0")
    # three names at most stand at the end, each of a few words
    ends = F.expr(f"sequence(greatest(1, size(words) - {2 * LONGEST}), size(words))")
    rows = rows.select("line", "text", "clause", "words", F.explode(ends).alias("b"))
    rows = rows.withColumn("a", F.explode(F.expr(f"sequence(greatest(0, b - {LONGEST}), b - 1)")))
    rows = rows.filter(~F.expr("exists(slice(words, a + 1, b - a - 1), w -> endswith(w, ','))"))
    rows = rows.withColumn("run", F.regexp_replace(F.array_join(F.expr("slice(words, a + 1, b - a)"), " "), ",$", ""))
    # a generator's value is computed once, for the filter and for the join
    return rows.withColumn("name", F.explode(F.array(normal(F.col("run"))))).filter("name <> ''")


def _words(clause: Column) -> Column:
    """Words of a clause; a comma ends a word's segment."""
    return F.regexp_extract_all(clause, F.lit(r"[^\s,]+,?"), F.lit(0))


def _spots(runs: DataFrame, names: DataFrame) -> DataFrame:
    """line, text, countries, regions, cities: what the gazetteer knows at the ends of a line's clauses; bare: the large city at a clause's end."""
    found = runs.join(names, "name")
    before, at_end = F.expr("get(words, a - 1)"), F.col("b") == F.size("words")
    # what a name may be by itself: a short code is to be written in capitals, unless a city vouches for it
    letters = F.regexp_replace("run", "[^A-Za-z]", "")
    written = F.when(F.length(letters) <= 3, letters == F.upper(letters)).otherwise(F.substring(F.trim(F.regexp_replace("run", r"^\(", "")), 1, 1).rlike(r"\p{Lu}"))
    # a country's full name may be written in any way
    free = (F.col("sure") & (written | (F.col("kind") == "country") & (F.length(letters) > 3))).alias("free")
    # a city begins a segment, or stands inside one
    is_city = (F.col("kind") == "city") & ((F.col("a") == 0) | F.endswith(before, F.lit(",")) | ~F.coalesce(normal(before).isin(*MODIFIERS), F.lit(False)))
    called = F.coalesce(F.nullif("label", F.lit("")), "run")
    large = is_city & at_end & (F.col("population") >= LARGE) & called.rlike(r"^\p{Lu}")
    listed = lambda which, *columns: F.collect_list(F.when(which, F.struct(*columns)))
    return found.groupBy("line").agg(
        F.first("text").alias("text"),
        listed((F.col("kind") == "country") & at_end, "clause", "a", "cc", "label", free).alias("countries"),
        listed(F.col("kind") == "region", "clause", "a", "b", at_end.alias("last"), "cc", "region", "label", free, F.col("city").alias("says")).alias("regions"),
        listed(is_city, "clause", "a", "b", "cc", "region", called.alias("city")).alias("cities"),
        F.max(F.when(large, F.struct("clause", (-F.col("a")).alias("n"), "population", called.alias("city")))).alias("bare"),
    )


def _heads() -> Column:
    """What stands right of a city: a region before a country, a region at the clause's end, a country."""
    region = "'a', r.a, 'cc', r.cc, 'region', r.region, 'label', r.label, 'region_free', r.free, 'says', r.says"
    no_region = "'a', c.a, 'cc', c.cc, 'region', string(NULL), 'label', string(NULL), 'region_free', true, 'says', string(NULL)"
    country, no_country = "'country', c.label, 'country_free', c.free", "'country', string(NULL), 'country_free', true"
    return F.expr(
        f"""concat(
        flatten(transform(regions, r -> transform(filter(countries, c -> c.clause = r.clause AND c.cc = r.cc AND c.a = r.b), c -> named_struct('clause', r.clause, {region}, {country})))),
        transform(filter(regions, r -> r.last), r -> named_struct('clause', r.clause, {region}, {no_country})),
        transform(countries, c -> named_struct('clause', c.clause, {no_region}, {country})))"""
    )


def _readings() -> Column:
    """city, from, vouched: the cities that a head can have."""
    # one that the gazetteer knows there
    known = "transform(filter(cities, c -> c.clause = clause AND c.cc = cc AND c.b = a AND (region IS NULL OR c.region = region)), c -> named_struct('city', c.city, 'from', c.a, 'vouched', true))"
    # a name that says the city too, with or without the city's own word before it
    said = "filter(array(named_struct('city', says, 'from', a, 'vouched', true)), x -> x.city IS NOT NULL)"
    # else the rest of the segment, as it is written; a country after other words of its segment needs a city
    inside = "region IS NULL AND a > 0 AND NOT coalesce(endswith(get(words, a - 1), ','), true)"
    good = f"rest <> '' AND NOT rest RLIKE '[0-9]' AND a - begin <= {LONGEST_CITY}"
    free = f"named_struct('city', if({good}, rest, NULL), 'from', if({good}, begin, a), 'vouched', false)"
    return F.expr(f"concat({known}, {said}, filter(array({free}), x -> region_free AND country_free AND says IS NULL AND NOT ({inside})))")


def peeled(texts: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """key, city, region, country, left, venue, confidence: a row per text whose clauses end in a place.

    The last clause with a region or a country counts; where there is none, a large city at the end of
    a clause stands for itself, without a country, at low confidence.  ``left`` is what the clause says before
    the place, ``venue`` that, else the clause after ``@``, else the clause before, else the one after.
    High confidence: the gazetteer knows the city in that region or country.  Null and blank texts give no rows.

    Equal lines are read once.  A line's runs are joined with the gazetteer once; what they mean
    together is read from the line's own list of what was found, without a further shuffle.
    """
    lines = texts.select(key, F.col(text).alias("line")).filter("line IS NOT NULL")
    return lines.join(_places(lines.select("line").distinct(), gazetteer), "line").drop("line")


def _places(lines: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """line, city, region, country, left, venue, confidence: a row per line (each once) that ends in a place."""
    names = gazetteer.withColumn("name", normal(F.col("name")))
    spots = _spots(_runs(_blanked(lines)), names)
    heads = spots.select("line", "text", "bare", "cities", F.explode_outer(_heads()).alias("h")).select("line", "text", "bare", "cities", "h.*")
    heads = heads.withColumn("words", F.explode_outer(F.array(_words(F.get(F.split("text", _CLAUSE), F.col("clause"))))))
    begin = F.expr("coalesce(array_max(filter(sequence(1, greatest(a - 1, 1)), i -> i < a AND endswith(get(words, i - 1), ','))), 0)")
    heads = heads.withColumn("begin", F.explode_outer(F.array(begin)))
    heads = heads.withColumn("rest", F.explode_outer(F.array(F.regexp_replace(F.array_join(F.expr("slice(words, begin + 1, a - begin)"), " "), ",$", ""))))
    readings = heads.withColumn("o", F.explode_outer(_readings()))
    rank = [F.col("clause"), F.col("o.vouched").cast("int"), F.col("country").isNotNull().cast("int"), F.col("region").isNotNull().cast("int"), -F.col("o.from"), F.col("cc") == "US", F.col("cc")]
    reading = F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), "region", "label", "o.city", "o.from", "o.vouched", "country")
    best = readings.groupBy("line").agg(F.first("text").alias("text"), F.first("bare").alias("bare"), F.max(F.when(F.col("o").isNotNull(), reading)).alias("x")).filter("x IS NOT NULL OR bare IS NOT NULL")
    # where nothing else is known, a large city
    either = lambda read, bare: F.when(F.col("x").isNotNull(), F.col(read)).otherwise(bare)
    confidence = F.when(F.col("x").isNull(), "low").when(F.col("x.vouched"), "high").otherwise("medium")
    best = best.select(
        "line",
        "text",
        either("x.r0", F.col("bare.clause")).alias("clause"),
        either("x.city", F.col("bare.city")).alias("city"),
        either("x.from", -F.col("bare.n")).alias("from"),
        F.col("x.label").alias("region"),
        "x.country",
        F.col("x.r6").alias("cc"),
        confidence.alias("confidence"),
    )
    states = names.filter("kind = 'country'").groupBy("cc").agg(F.max("label").alias("of_cc"))
    out = best.join(F.broadcast(states), "cc", "left").withColumn("country", F.coalesce("country", "of_cc"))

    # the clauses around it
    parts = F.transform(F.split("text", _CLAUSE), F.trim)
    left = F.regexp_replace(F.array_join(F.slice(_words(F.get(parts, F.col("clause"))), F.lit(1), F.col("from")), " "), r"[\s,]+$", "")
    signs = F.regexp_extract_all(F.col("text"), F.lit(_CLAUSE), F.lit(0))
    out = out.withColumn("left", left).withColumn("parts", parts).withColumn("signs", signs)
    after, before = F.get("parts", F.col("clause") + 1), F.get("parts", F.col("clause") - 1)
    at = F.when(F.trim(F.get("signs", F.col("clause"))) == "@", after)
    full = lambda c: F.nullif(c, F.lit(""))
    venue = F.coalesce(full(F.col("left")), full(at), full(before), full(after), F.lit(""))
    shown = F.when((F.col("city") == F.upper("city")) | (F.col("city") == F.lower("city")), F.initcap("city")).otherwise(F.col("city"))
    return out.select("line", shown.alias("city"), "region", "country", "left", venue.alias("venue"), "confidence")


def gazetteer(c: Catalogue) -> DataFrame:
    """Nations as countries, their regions as regions with codes, and two words of a part's name as each supplier's city."""
    nation = c.table("nation").join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.concat(F.substring("n_name", 1, 1), F.lit("Q"))
    cc, none, label = F.col("n_nationkey").cast("string"), F.lit(None).cast("string"), F.initcap(F.col("n_name"))
    country = nation.select(F.lit("country").alias("kind"), F.col("n_name").alias("name"), cc.alias("cc"), none.alias("region"), label.alias("label"), F.lit(True).alias("sure"), none.alias("city"), F.lit(None).cast("long").alias("population"))
    region = nation.select(F.lit("region").alias("kind"), F.concat(F.lit("Z"), code, F.col("n_nationkey")).alias("name"), cc.alias("cc"), code.alias("region"), F.concat(F.initcap("r_name"), F.lit(" "), label).alias("label"), F.lit(True).alias("sure"), none.alias("city"), F.lit(None).cast("long").alias("population"))
    parts = c.table("part").select(F.col("p_partkey").alias("s_suppkey"), F.expr("initcap(array_join(slice(split(p_name, ' '), 1, 2), ' '))").alias("town"))
    towns = c.table("supplier").join(parts, "s_suppkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    town = towns.select(F.lit("city").alias("kind"), F.col("town").alias("name"), cc.alias("cc"), code.alias("region"), none.alias("label"), F.lit(True).alias("sure"), none.alias("city"), F.lit(60_000).cast("long").alias("population")).distinct()
    return reduce(DataFrame.unionByName, [country, region, town])


def _lines(c: Catalogue) -> DataFrame:
    """A line for each line item, written in six ways: place of its supplier, hall, date."""
    parts = c.table("part").select(F.col("p_partkey").alias("s_suppkey"), F.expr("array_join(slice(split(p_name, ' '), 1, 2), ' ')").alias("town"))
    rows = c.table("orders").withColumn("s_suppkey", F.col("o_orderkey") % 7 + 1).join(c.table("supplier"), "s_suppkey").join(parts, "s_suppkey")
    rows = rows.join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    town, land, day = F.initcap("town"), F.initcap("n_name"), F.date_format("o_orderdate", "MMMM d, yyyy")
    ways = [
        F.concat(F.lit("Old Hall, "), town, F.lit(", "), land),
        F.concat(town, F.lit(", "), land, F.lit(" @ The Barn")),
        F.concat(F.lit("Stars - "), F.upper(town), F.lit(", "), F.col("n_name"), F.lit(" "), day),
        F.concat(F.lit("Blue Room, Nowhere, "), land),
        F.concat(F.lit("Long Wharf "), town, F.lit(" "), land),
        F.concat(F.lit("Royal Hall, "), town),
        F.concat(F.lit("set two and "), F.lower(land)),
    ]
    return rows.select("o_orderkey", F.element_at(F.array(*ways), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("line"))


def peeled_places(c: Catalogue) -> DataFrame:
    return peeled(_lines(c), "o_orderkey", "line", gazetteer(c))
