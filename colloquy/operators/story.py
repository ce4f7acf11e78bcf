"""Story cards: rankings of cities, highlighted cities, and the formatted values of each card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions import values
from ..sources.shared import checkpointed
from .insights import best, breakdown, cells, cities, ribbon, totals, widest_divide


def loudest(rows: DataFrame, k: int = 3) -> DataFrame:
    """Cities by posts, ties by name."""
    return rows.orderBy(F.desc("total"), "city").limit(k)


def by_net(rows: DataFrame, warm: bool, k: int = 3) -> DataFrame:
    """Cities of five posts at least by net sentiment; ties go to more posts, then the name, both ways."""
    ranked = rows.where(F.col("total") >= model.MIN_TOTAL).withColumn("net", values.net())
    return ranked.orderBy(F.desc("net") if warm else F.asc("net"), F.desc("total"), "city").limit(k)


_NET = "(positive - negative)::double / total"


@query("top3_volume", "select city, total from cities order by total desc, city limit 3")
def top3_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loudest(cities(spark, sf_dir)).select("city", "total")


@query("top3_warm", f"select city, round({_NET}, 6) as net from cities where total >= 5 order by {_NET} desc, total desc, city limit 3")
def top3_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_net(cities(spark, sf_dir), True).select("city", F.round("net", 6).alias("net"))


@query("top3_cool", f"select city, round({_NET}, 6) as net from cities where total >= 5 order by {_NET}, total desc, city limit 3")
def top3_cool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_net(cities(spark, sf_dir), False).select("city", F.round("net", 6).alias("net"))


@query(
    "highlight_summary_trio",
    f"select city, min(place)::integer as place from (select 1 as place, (select city from cities where total >= 5 order by {_NET} desc, total desc, city limit 1) as city union all select 2, (select city from cities where total >= 5 order by {_NET}, total desc, city limit 1) union all select 3, (select city from cities order by total desc, city limit 1)) where city is not null group by city",
)
def highlight_summary_trio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warmest, coolest and loudest city, each once, with the first place it takes."""
    rows = cities(spark, sf_dir)
    picked = [by_net(rows, True, 1), by_net(rows, False, 1), loudest(rows, 1)]
    out = None
    for place, one in enumerate(picked, 1):
        own = one.select("city", F.lit(place).alias("place"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("city").agg(F.min("place").alias("place"))


def story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beat, token and value of the cards that the data supports; names are escaped, numbers formatted."""
    rows, found = cities(spark, sf_dir), cells(spark, sf_dir)
    # a row for each city and source; every card folds these, so they are computed once
    rows, found = checkpointed(rows), checkpointed(found)

    def card(beat: str, df: DataFrame, **tokens) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(t).alias("token"), v.alias("value")) for t, v in tokens.items()])
        return df.select(F.lit(beat).alias("beat"), F.explode(pairs).alias("p")).select("beat", "p.token", "p.value")

    name, net_of = values.escaped, values.net_text
    all_ = totals(rows).where("total > 0").withColumn("net", values.net())
    kinds = ribbon(found)
    n_kinds = kinds.agg(F.count("*").alias("kinds"))
    head = all_.join(F.broadcast(n_kinds))
    overview = card("overview", head, cityCount=values.count_text(F.col("cities")), totalPosts=values.count_text(F.col("total")), globalNet=net_of(F.col("net")), categoryCount=values.count_text(F.col("kinds")))
    top = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("k"), "city")))
    three = loudest(rows).agg(top.alias("t")).where("size(t) = 3").join(F.broadcast(all_.select("total")))
    volume = card(
        "volume", three, **{f"volumeCity{i}": name(F.col("t")[i - 1]["city"]) for i in (1, 2, 3)}, **{f"volumeCount{i}": values.count_text(-F.col("t")[i - 1]["k"]) for i in (1, 2, 3)},
        topThreeSharePct=values.percent_text(-(F.col("t")[0]["k"] + F.col("t")[1]["k"] + F.col("t")[2]["k"]) / F.col("total")),
    )
    d = widest_divide(found)
    divide = card("divide", d, divideCity=name(F.col("city")), divideHiCategory=name(F.col("hi_category")), divideHiNet=net_of(F.col("hi_net")), divideLoCategory=name(F.col("lo_category")), divideLoNet=net_of(F.col("lo_net")))
    cards = overview.unionByName(volume).unionByName(divide)
    for beat, prefix, warm in (("negativity", "neg", False), ("positivity", "pos", True)):
        sign = -1 if warm else 1
        ends = by_net(rows, warm).agg(F.array_sort(F.collect_list(F.struct((sign * F.col("net")).alias("k"), (-F.col("total")).alias("n"), "city"))).alias("t")).where("size(t) = 3")
        share = F.struct((-F.col("share")).alias("k"), "category")
        leading = breakdown(found).groupBy("city").agg(F.min(share).alias("c"))
        ends = ends.withColumn("city", F.col("t")[0]["city"]).join(leading, "city")
        cards = cards.unionByName(card(beat, ends, **{f"{prefix}City{i}": name(F.col("t")[i - 1]["city"]) for i in (1, 2, 3)}, **{f"{prefix}Net{i}": net_of(sign * F.col("t")[i - 1]["k"]) for i in (1, 2, 3)}, **{f"{prefix}Category1": name(F.col("c.category"))}))
    order = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("k"), "category")))
    leaders = kinds.agg(order.alias("t")).where("size(t) >= 2")
    drivers = card("drivers", leaders, catShare1Category=name(F.col("t")[0]["category"]), catShare1Pct=values.percent_text(-F.col("t")[0]["k"]), catShare2Category=name(F.col("t")[1]["category"]), catShare2Pct=values.percent_text(-F.col("t")[1]["k"]), categoryCount=values.count_text(F.size("t")))
    at = F.struct((-F.col("net")).alias("k"), "category", "top_source")
    ends = kinds.agg(F.min(at).alias("hi"), F.max(at).alias("lo"), F.count("*").alias("n")).where("n >= 2")
    messengers = card(
        "messengers", ends, msgHiCategory=name(F.col("hi.category")), msgHiNet=net_of(-F.col("hi.k")), msgHiSource=name(F.col("hi.top_source")), msgLoCategory=name(F.col("lo.category")), msgLoNet=net_of(-F.col("lo.k")),
        msgLoSource=name(F.col("lo.top_source")), msgGap=values.fixed(F.col("lo.k") - F.col("hi.k"), 2),
    )
    warmest, coolest = (by_net(rows, w, 1).select(F.col("city").alias(f"{k}_city"), F.col("net").alias(f"{k}_net")) for k, w in (("warm", True), ("cool", False)))
    eligible = rows.where(F.col("total") >= model.MIN_TOTAL).agg(F.count("*").alias("eligible")).where("eligible >= 2")
    closing = head.join(F.broadcast(warmest)).join(F.broadcast(coolest)).join(F.broadcast(eligible))
    summary = card("summary", closing, totalPosts=values.count_text(F.col("total")), globalNet=net_of(F.col("net")), categoryCount=values.count_text(F.col("kinds")), warmestCity=name(F.col("warm_city")), warmestNet=net_of(F.col("warm_net")), coolestCity=name(F.col("cool_city")), coolestNet=net_of(F.col("cool_net")))
    return cards.unionByName(drivers).unionByName(messengers).unionByName(summary)


@query("story_tokens")
def story_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story(spark, sf_dir)


#: Camera of the whole globe, for chapters without highlight or view of their own.
GLOBAL_VIEW = (20.0, 10.0)


def chapter(beat: str, template: str, fallback: str, found: list, highlights: list | None = None, view: tuple[float, float] | None = None, demo: bool = False) -> dict:
    """One card on the driver: its text from the tokens (a few rows), else the fallback; the camera from the first highlight, the chapter's view, or the globe."""
    own = {r["token"]: r["value"] for r in found if r["beat"] == beat}
    placed = [h for h in highlights or [] if h["lat"] is not None and h["lng"] is not None]
    camera = (placed[0]["lng"], placed[0]["lat"]) if placed else view or GLOBAL_VIEW
    return {"beat": beat, "text": values.rendered(template, own) if own else fallback, "camera": camera, "demo": demo}
