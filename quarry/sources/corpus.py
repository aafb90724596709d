"""A synthetic web corpus, derived row by row from a seed.

Every choice is a hash of the seed, the page and a counter, so any page can be
made anywhere, in any number of partitions, always the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.functions.html import HOST

#: Topic, its words, and the rare phrase of its spotlight page.
TOPICS = [
    ("sailing", "mainsail keel rudder harbour tide anchor spinnaker halyard tiller mooring", "storm jib reefing"),
    ("beekeeping", "hive queen brood nectar smoker swarm pollen drone beeswax apiary", "varroa mite treatment"),
    ("chess", "opening gambit bishop endgame castling fianchetto tempo pawn stalemate knight", "poisoned pawn variation"),
    ("pottery", "clay kiln glaze slip wheel bisque porcelain throwing handle stoneware", "ash glaze crackle"),
    ("geology", "basalt strata fault sediment quartz erosion magma fossil granite mineral", "columnar jointing basalt"),
    ("knitting", "yarn needle stitch cable gauge ribbing sleeve cardigan purl pattern", "fair isle yoke"),
    ("theatre", "stage rehearsal curtain prompter costume monologue lighting audience director prop", "fourth wall aside"),
    ("railways", "locomotive signal gauge tunnel viaduct carriage platform freight timetable siding", "rack railway gradient"),
    ("birding", "warbler plumage binoculars migration nest heron falcon songbird hide roost", "murmuration dusk count"),
    ("typography", "serif kerning glyph baseline ligature typeface margin italic leading ampersand", "optical margin alignment"),
]
TITLES = ["Getting to know the {a}", "{a} in practice", "Notes on {a} and {b}", "The {a} handbook", "How {a} changes {b}", "Ten facts about the {a}"]
SENTENCES = [
    "The {a} deserves a closer look than it usually gets.",
    "Anyone who works with a {a} will sooner or later need a {b}.",
    "Good results start with the {a}, and end with the {b}.",
    "People argue about {a} and {b} all the time.",
    "A careful {a} saves more effort than any {b}.",
    "Most guides on {a} leave out the {b} entirely.",
    "Try the {a} first, then compare it with the {b}.",
]
GENERAL = ["Practice makes the difference here.", "There are several sound ways to begin.", "Keep notes, and compare them later.", "Small changes add up over a season."]
HUBS, SPOTLIGHT = 2, 2
THIN, CROSS, TO_ADMIN, RARE = 0.15, 0.08, 0.05, 0.35


def _draw(seed: int, *keys) -> Column:
    """A number of 31 bits from the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 31))


def _chance(seed: int, *keys) -> Column:
    return _draw(seed, *keys) / F.lit(float(1 << 31))


def _pick(items: Column, draw: Column) -> Column:
    return F.get(items, F.pmod(draw, F.size(items)).cast("int"))


def _filled(template: Column, a: Column, b: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{a}"), a), F.lit("{b}"), b)


def pages(spark: SparkSession, seed: int = 7, n: int = 2500, partitions: int | None = None) -> DataFrame:
    """id, topic, kind (hub, spotlight, regular, thin, admin), place (within the topic), url, title, body, ord.

    Topics get n / 10 pages each, the first ones the remainder, with ids in
    topic order; n // 100 admin pages come on top.
    """
    k = len(TOPICS)
    base, more = divmod(n, k)
    number = F.col("number")
    wide = more * (base + 1)
    topic = F.when(number < wide, F.floor(number / F.lit(base + 1))).otherwise(more + F.floor((number - wide) / F.lit(max(base, 1)))).cast("int")
    first = F.when(F.col("t") <= more, F.col("t") * (base + 1)).otherwise(wide + (F.col("t") - more) * base)
    content = (
        spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism)
        .withColumnRenamed("id", "number")
        .withColumn("t", topic)
        .withColumn("place", (number - first).cast("int"))
        .select(F.format_string("p%04d", number + 1).alias("id"), _pick(F.array(*[F.lit(t) for t, _, _ in TOPICS]), F.col("t")).alias("topic"), "t", "place", number.alias("ord"))
        .withColumn("kind", F.when(F.col("place") < HUBS, "hub").when(F.col("place") == SPOTLIGHT, "spotlight").when(_chance(seed, "thin", F.col("id")) < THIN, "thin").otherwise("regular"))
    )
    admin = spark.range(n // 100).select(F.format_string("a%04d", F.col("id") + 1).alias("id"), F.lit("admin").alias("topic"), F.lit(0).alias("t"), F.col("id").cast("int").alias("place"), (F.col("id") + n).alias("ord"), F.lit("admin").alias("kind"))
    every = content.union(admin.select(*content.columns))
    words = _pick(F.array(*[F.array(*map(F.lit, w.split())) for _, w, _ in TOPICS]), F.col("t"))
    rare = _pick(F.array(*[F.lit(r) for _, _, r in TOPICS]), F.col("t"))
    paragraphs = F.when(F.col("kind") == "hub", 5 + F.pmod(_draw(seed, "p", F.col("id")), F.lit(3))).when(F.col("kind") == "spotlight", 5).when(F.col("kind") == "thin", 2).otherwise(3 + F.pmod(_draw(seed, "p", F.col("id")), F.lit(4))).cast("int")

    def sentence(p: Column, s: Column) -> Column:
        key = (F.col("id"), p, s)
        own = _filled(_pick(F.array(*map(F.lit, SENTENCES)), _draw(seed, "s", *key)), _pick(F.col("words"), _draw(seed, "a", *key)), _pick(F.col("words"), _draw(seed, "b", *key)))
        general = _pick(F.array(*map(F.lit, GENERAL)), _draw(seed, "g", *key))
        special = F.concat(F.lit("Nothing here matters as much as "), F.col("rare"), F.lit("."))
        return F.when((F.col("kind") == "spotlight") & (_chance(seed, "r", *key) < RARE), special).when(_chance(seed, "o", *key) < 0.2, general).otherwise(own)

    body = F.transform(
        F.sequence(F.lit(1), F.col("paragraphs")),
        lambda p: F.array_join(F.transform(F.sequence(F.lit(1), (3 + F.pmod(_draw(seed, "n", F.col("id"), p), F.lit(5))).cast("int")), lambda s: sentence(p, s)), " "),
    )
    title = F.when(F.col("kind") == "admin", F.concat(F.lit("Console "), F.col("id"))).when(F.col("kind") == "spotlight", F.initcap("rare")).otherwise(
        _filled(_pick(F.array(*map(F.lit, TITLES)), _draw(seed, "t", F.col("id"))), _pick(F.col("words"), _draw(seed, "ta", F.col("id"))), _pick(F.col("words"), _draw(seed, "tb", F.col("id"))))
    )
    return (
        every.withColumns({"words": words, "rare": rare, "paragraphs": paragraphs})
        .withColumns({"title": title, "body": body})
        .select("id", "topic", "kind", "place", F.concat(F.lit(f"{HOST}/"), "topic", F.lit("/"), "id").alias("url"), "title", "body", "ord")
    )


def links(pages_: DataFrame, seed: int = 7) -> DataFrame:
    """src, dst, place: distinct links without loops; every content page is linked from a hub of its topic."""
    base = pages_.select("id", "topic", "kind", "place")
    sizes = base.where("kind <> 'admin'").groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    admins = base.where("kind = 'admin'").agg(F.count(F.lit(1)).alias("admins"))
    topics = [t for t, _, _ in TOPICS]
    own = base.join(F.broadcast(sizes), "topic", "left").join(F.broadcast(admins))
    draw = lambda *k: _draw(seed, *k, F.col("id"))
    intra = F.when(F.col("kind") == "hub", 40 + F.pmod(draw("ni"), F.lit(31))).when(F.col("kind") == "thin", 2 + F.pmod(draw("ni"), F.lit(2))).when(F.col("kind") == "admin", 0).otherwise(3 + F.pmod(draw("ni"), F.lit(4)))
    cross = F.when(F.col("kind") == "hub", 3 + F.pmod(draw("nc"), F.lit(4))).when((F.col("kind") != "admin") & (_chance(seed, "c", F.col("id")) < CROSS), 1 + F.pmod(draw("nc"), F.lit(2))).otherwise(0)
    to_hub = F.when(F.col("kind").isin("regular", "thin", "spotlight"), 1).otherwise(0)
    to_admin = F.when(F.col("kind") == "admin", 2).when(_chance(seed, "ad", F.col("id")) < TO_ADMIN, 1).otherwise(0)
    from_admin = F.when(F.col("kind") == "admin", 2).otherwise(0)

    def choices(name: str, count: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int")), lambda i: i < count), lambda i: F.struct(F.lit(name).alias("how"), i.alias("i"), _draw(seed, name, F.col("id"), i).alias("d"), _draw(seed, name + "x", F.col("id"), i).alias("e")))

    wanted = own.select("id", "topic", "place", "size", "admins", F.explode(F.concat(choices("hub", to_hub), choices("intra", intra), choices("cross", cross), choices("admin", to_admin), choices("back", from_admin))).alias("c")).select("*", "c.*")
    anywhere = _pick(F.array(*map(F.lit, topics)), F.col("e"))
    to_topic = F.when(F.col("how").isin("cross", "back"), anywhere).when(F.col("how") == "admin", "admin").otherwise(F.col("topic"))
    aimed = wanted.withColumn("to_topic", to_topic).drop("topic", "size").join(F.broadcast(sizes.withColumnRenamed("topic", "to_topic")), "to_topic", "left")
    room = F.when(F.col("how") == "hub", F.least(F.lit(HUBS), F.col("size"))).when(F.col("how") == "admin", F.col("admins")).otherwise(F.col("size"))
    to = aimed.withColumn("to_place", F.when(room > 0, F.pmod(F.col("d"), room).cast("int"))).where("to_place IS NOT NULL")
    targets = base.select(F.col("topic").alias("to_topic"), F.col("place").alias("to_place"), F.col("id").alias("dst"))
    made = to.join(targets, ["to_topic", "to_place"]).select(F.col("id").alias("src"), "dst", F.xxhash64("how", "i").alias("key"))
    hubs = base.where(f"kind = 'hub' AND place < {HUBS}").select(F.col("id").alias("src"), "topic", F.col("place").alias("hub"))
    chosen = F.pmod(_draw(seed, "fix", F.col("id")), F.least(F.lit(HUBS), F.col("size"))).cast("int")
    # a hub is linked from the other one
    other = F.when(F.col("place") == chosen, F.pmod(chosen + 1, F.least(F.lit(HUBS), F.col("size")).cast("int"))).otherwise(chosen)
    content = base.where("kind <> 'admin'").join(F.broadcast(sizes), "topic").select(F.col("id").alias("dst"), "topic", other.alias("hub"))
    linked = made.join(hubs.select("src"), "src", "left_semi").join(base.select(F.col("id").alias("src"), F.col("topic").alias("st")), "src").join(base.select(F.col("id").alias("dst"), F.col("topic").alias("dt")), "dst").where("st = dt AND src <> dst").select("dst").distinct()
    repaired = content.join(linked, "dst", "left_anti").join(hubs, ["topic", "hub"]).select("src", "dst", F.lit((1 << 62)).alias("key"))
    every = made.union(repaired).where("src <> dst").groupBy("src", "dst").agg(F.min("key").alias("key"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("key", "dst"))).select("src", "dst", "place")


def rendered(pages_: DataFrame, links_: DataFrame) -> DataFrame:
    """id, url, title, outlinks, html, ord; noise that a crawler must ignore is part of the page."""
    out = links_.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "dst"))), lambda x: x.dst).alias("outlinks"))
    rows = pages_.join(out.withColumnRenamed("src", "id"), "id", "left").withColumn("outlinks", F.coalesce("outlinks", F.array().cast("array<string>")))

    def escaped(text: Column) -> Column:
        for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(character), F.lit(entity))
        return text

    anchors = F.array_join(F.transform("outlinks", lambda t: F.concat(F.lit('<li><a href="'), t, F.lit('">'), t, F.lit("</a></li>"))), "")
    paragraphs = F.array_join(F.transform("body", lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "\n")
    page = F.concat(
        F.lit("<!DOCTYPE html>\n<html><head><title>"), escaped(F.col("title")),
        F.lit("</title><style>body { margin: 2em; }</style><script>var page = '<p>none</p>';</script></head>\n<body><!-- generated -->\n<h1>"), escaped(F.col("title")),
        F.lit("</h1>\n"), paragraphs, F.lit("\n<ul>"), anchors, F.lit("</ul>\n</body></html>\n"),
    )
    return rows.select("id", "url", "title", "outlinks", page.alias("html"), "ord")


def generate(spark: SparkSession, path: str, seed: int = 7, n: int = 2500) -> dict[str, int]:
    """Writes the corpus as one table of pages at ``path``; the figures of what it holds."""
    made = pages(spark, seed, n)
    rendered(made, links(made, seed)).write.mode("overwrite").parquet(path)
    return {"pages": n, "admin": n // 100}
