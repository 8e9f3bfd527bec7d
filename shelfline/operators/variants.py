"""Variant groups: cards that are one model in several colours, memories and SIM layouts.

Groups are returned as labelled rows, one per card, so that a group of any size stays distributed.
``scope`` columns (a request, for instance) keep independent card lists apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.functions import colors, variants
from shelfline.functions import vocabulary as v
from shelfline.functions.text import fold, lookup, natural_key
from shelfline.operators.pricing import first_per
from shelfline.session import reliable_checkpoint, spread


def group_by_key(cards: DataFrame, key: Column, title: Column, scope: Sequence[str] = (), position: str = "position") -> DataFrame:
    """Label every card with its group key, the group title (of its first card), size and first position."""
    keyed = cards.withColumns({"group_key": key, "_title": title})
    groups = keyed.groupBy(*scope, "group_key").agg(
        F.min_by("_title", position).alias("group_title"), F.min(position).alias("group_position"), F.count(F.lit(1)).alias("group_size"))
    return keyed.drop("_title").join(groups, [*scope, "group_key"])


def group_product_variants(cards: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    staged = cards.withColumn("_base", variants.base_title(F.col("title")))
    return group_by_key(staged, F.lower("_base"), F.col("_base"), scope).drop("_base")


def group_by_memory(cards: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Groups by memory label with ``group_order``: by size, cards without memory last."""
    label = F.coalesce(variants.memory_label(F.col("title")), F.lit(v.NO_MEMORY_CHOICE))
    grouped = group_by_key(cards.withColumn("_label", label), F.col("_label"), F.col("_label"), scope).drop("_label")
    order = variants.memory_order(F.col("group_key"))
    return grouped.withColumn("group_order", F.struct(
        (~order["known"]).alias("unknown"), F.coalesce(F.array_max(order["sizes"]), F.lit(0)).alias("largest"),
        F.array_join(F.transform(order["sizes"], lambda s: F.lpad(s.cast("string"), 12, "0")), "/").alias("sizes")))


def memory_choices(cards: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Explicit memory labels, largest first, with ``has_choice`` if a scope has more than one."""
    label = variants.memory_label(F.col("title"))
    labels = cards.withColumn("memory", label).filter("memory IS NOT NULL").groupBy(*scope, "memory").agg(F.count(F.lit(1)).alias("cards"))
    order = variants.memory_order(F.col("memory"))
    ranked = labels.withColumn("_order", F.struct(order["sizes"].alias("sizes"), F.lower("memory").alias("label")))
    counted = ranked.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")) if scope else ranked.agg(F.count(F.lit(1)).alias("_n"))
    window = Window.partitionBy(*scope).orderBy(F.desc("_order"))
    joined = ranked.join(counted, list(scope)) if scope else ranked.withColumn("_one", F.lit(1)).join(counted.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.withColumns({"place": F.row_number().over(window), "has_choice": F.col("_n") > 1}).drop("_order", "_n")


def group_by_sim(cards: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Groups by SIM configuration with label and order, unknown last."""
    config = F.coalesce(variants.sim_config(F.col("title")), F.lit("unknown"))
    staged = cards.withColumn("_sim", config)
    grouped = group_by_key(staged, F.col("_sim"), lookup(v.SIM_LABELS, F.col("_sim")), scope).drop("_sim")
    return grouped.withColumn("group_order", F.struct((F.col("group_key") == "unknown").alias("unknown"), F.col("group_title").alias("label")))


def _model_sources(cards: DataFrame, title: str, scope: Sequence[str]) -> DataFrame:
    """Replace a title by its stem where a closing parenthesis proves to be a colour.

    It does if the stem occurs with two different parentheses, or also without one.
    """
    # three consumers read the derived keys, so they are computed once and cut off here
    staged = spread(cards).withColumns({"_own": variants.group_key(variants.model_title(F.col(title))), "_p": variants.parenthesis_stem(F.col(title))})
    staged = reliable_checkpoint(staged.withColumn("_stem_key", variants.group_key(variants.model_title(F.col("_p.stem")))))
    stems = staged.filter("_p IS NOT NULL").groupBy(*scope, "_stem_key").agg(F.count_distinct("_p.suffix").alias("_n"))
    bare = staged.select(*scope, F.col("_own").alias("_stem_key"), F.lit(True).alias("_bare")).distinct()
    proven = stems.join(bare, [*scope, "_stem_key"], "left").filter((F.col("_n") >= 2) | F.col("_bare")).select(
        *scope, "_stem_key", F.lit(True).alias("_color"))
    joined = staged.join(proven, [*scope, "_stem_key"], "left")
    return joined.withColumn("_source", F.when(F.col("_color"), F.col("_p.stem")).otherwise(F.col(title))).drop("_own", "_p", "_stem_key", "_color")


def group_model_variants(cards: DataFrame, scope: Sequence[str] = (), title: str = "title") -> DataFrame:
    """Colours and memories of one physical model as one group."""
    staged = reliable_checkpoint(_model_sources(cards, title, scope).withColumn("_model", variants.model_title(F.col("_source"))))
    return group_by_key(staged, variants.group_key(F.col("_model")), F.col("_model"), scope).drop("_source", "_model")


def group_display_models(cards: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Groups of a selection screen: cleaned titles, store codes dropped where sibling cards justify it."""
    staged = spread(cards).withColumn("_shown", variants.display_title(F.col("title")))
    staged = staged.withColumn("_sku", variants.trailing_sku(F.col("_shown")))
    key = lambda t: variants.group_key(variants.display_title(t))
    staged = reliable_checkpoint(staged.withColumns({
        "_stem_key": key(F.col("_sku.stem")), "_bare_key": F.when(F.col("_sku").isNull(), key(F.col("_shown")))}))
    codes = staged.filter("_sku IS NOT NULL").groupBy(*scope, "_stem_key").agg(
        F.count_distinct("_sku.code").alias("_codes"), F.bool_or(colors.selection_color_key(F.col("_sku.stem")).isNotNull()).alias("_colored"))
    bare = staged.filter("_bare_key IS NOT NULL").select(*scope, F.col("_bare_key").alias("_stem_key"), F.lit(True).alias("_bare")).distinct()
    droppable = (codes.join(bare, [*scope, "_stem_key"], "left").filter((F.col("_codes") >= 2) | F.col("_colored") | F.col("_bare"))
                 .select(*scope, "_stem_key", F.lit(True).alias("_drop")))
    joined = staged.join(droppable, [*scope, "_stem_key"], "left")
    shown = variants.display_title(F.when(F.col("_drop"), F.col("_sku.stem")).otherwise(F.col("_shown")))
    cleaned = joined.withColumn("_title", shown).drop("_shown", "_sku", "_stem_key", "_bare_key", "_drop")
    return group_model_variants(cleaned, scope, "_title").drop("_title")


def color_choices(cards: DataFrame, scope: Sequence[str] = ("request_id",), by_memory: bool = False) -> DataFrame:
    """Selectable colours: coloured cards only if there are any; the label names the memory if a colour has several."""
    staged = cards.withColumns({"color_key": colors.requested_color(F.col("title")), "_label": colors.color_label(F.col("title"))})
    memory = F.coalesce(variants.memory_label(F.col("title")), F.lit(v.NO_MEMORY_IN_COLOR)) if by_memory else F.lit("")
    any_color = staged.groupBy(*scope).agg(F.count_if(F.col("color_key").isNotNull()).alias("_colored"))
    usable = (staged.join(any_color, list(scope)).filter((F.col("_colored") == 0) | F.col("color_key").isNotNull())
              .withColumns({"color_key": F.coalesce("color_key", F.lit("unknown")), "memory": memory}))
    groups = usable.groupBy(*scope, "color_key", "memory").agg(
        F.min_by(F.struct("title", "_label"), "position").alias("_first"), F.count(F.lit(1)).alias("cards"))
    same_color = F.count(F.lit(1)).over(Window.partitionBy(*scope, "color_key"))
    label = F.coalesce("_first._label", F.lit(v.NO_COLOR_LABEL))
    order = Window.partitionBy(*scope).orderBy(F.lower(F.coalesce("_first._label", F.lit(""))), "memory", F.lower("_first.title"))
    return groups.withColumn("_n", same_color).withColumn("place", F.row_number().over(order)).select(
        *scope, "color_key", "memory", F.col("_first.title").alias("title"),
        F.when(F.lit(by_memory) & (F.col("_n") > 1), F.concat_ws(" · ", label, "memory")).otherwise(label).alias("label"), "cards", "place")


def collapse_color_variants(cards: DataFrame, request: str = "request_id", query: str = "query") -> DataFrame:
    """First card per colour-free title, unless the query names a colour."""
    agnostic = F.trim(F.regexp_replace(F.lower(colors.neutral_of_color(F.col("title"))), "[^a-zа-я0-9]+", " "))
    staged = cards.withColumns({"_named": colors.requested_color(F.col(query)).isNotNull(), "_key": agnostic})
    collapsed = first_per(staged.filter(~F.col("_named")), [request, "_key"], ["position"])
    return staged.filter("_named").unionByName(collapsed).drop("_named", "_key")


def order_groups(groups: DataFrame, key: Callable[[Column], Column] = natural_key, title: str = "group_title",
                 scope: Sequence[str] = ()) -> DataFrame:
    """Rank distinct groups with newer and larger models first; the sort key is injectable."""
    distinct = groups.select(*scope, title).distinct().withColumn("_key", key(F.col(title)))
    order = Window.partitionBy(*scope).orderBy(F.desc("_key"), F.desc(fold(F.col(title))))
    return distinct.withColumn("group_place", F.row_number().over(order)).drop("_key") if scope else distinct.orderBy(
        F.desc("_key"), F.desc(fold(F.col(title)))).drop("_key")
