"""Label sequences over arrays of entries, one array for each question (NUM-04..09).

An entry is struct(label, auto_fmt, ...). Arrays are bounded by a question, and every rule is an expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_ambiguous, is_roman, label_format, label_position, make_label, same_sequence
from ..functions.text import let, unpacked


def with_anchors(df: DataFrame, labels: str) -> DataFrame:
    """``df`` with _known: struct(at, form, position) of each label of an array column that has a format. Ambiguous letters take the format of the first roman one."""
    found = F.filter(F.transform(labels, lambda x, i: F.struct(i.alias("at"), x.alias("label"), label_format(x).alias("form"))), lambda a: a["form"].isNotNull())

    def known(found: Column) -> Column:
        return let(F.try_element_at(F.filter(found, lambda a: is_roman(a["form"])), F.lit(1))["form"], lambda roman: F.transform(found, lambda a: one(a, roman)))

    def one(a: Column, roman: Column) -> Column:
        form = F.when(roman.isNotNull() & a["form"].isin("a", "A") & is_ambiguous(a["label"]), roman).otherwise(a["form"])
        return let(form, lambda f: F.struct(a["at"].alias("at"), f.alias("form"), label_position(a["label"], f).alias("position")))

    return df.withColumn("_known", let(found, known))


def with_filled_gaps(df: DataFrame, labels: str, out: str) -> DataFrame:
    """Empty labels filled by place if all anchors have one format and one offset; else as they are. Steps are bound by ``let``, as an expression within a lambda is worked out for each element."""
    rows = with_anchors(df, labels)

    def filled(known: Column) -> Column:
        first = F.try_element_at(known, F.lit(1))
        facts = F.struct(first["form"].alias("form"), (first["position"] - first["at"]).alias("offset"))
        return let(facts, lambda f: let(F.struct(f["form"].alias("form"), f["offset"].alias("offset"), fits(known, f).alias("fine")), each))

    def fits(known: Column, f: Column) -> Column:
        return (F.size(known) > 0) & (f["offset"] >= 0) & F.forall(known, lambda a: (a["form"] == f["form"]) & (a["position"] - a["at"] == f["offset"]))

    def each(f: Column) -> Column:
        return F.transform(labels, lambda x, i: F.when(f["fine"] & (x == ""), make_label(i + f["offset"], f["form"])).otherwise(x))

    return rows.withColumn(out, let(F.col("_known"), filled)).drop("_known")


def with_marker_labels(df: DataFrame, labels: str, formats: str, out: str) -> DataFrame:
    """Entries with an automatic number and no label take 0, 1, ... of its format, if there is one format, typed labels go with it, and those places are free; else null."""
    rows = df.withColumn("_both", F.zip_with(labels, formats, lambda x, f: F.struct(x.alias("label"), f.alias("fmt"))))
    rows = rows.withColumn("_marked", F.filter("_both", lambda e: (e["label"] == "") & (e["fmt"] != "")))
    rows = rows.withColumn("_form", F.try_element_at("_marked", F.lit(1))["fmt"])
    rows = rows.withColumn("_typed", F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.struct(x.alias("label"), label_format(x).alias("form"))))
    fits = F.forall("_typed", lambda t: t["form"].isNotNull() & same_sequence(t["form"], F.col("_form")))
    free = ~F.exists("_typed", lambda t: (label_position(t["label"], t["form"]) >= 0) & (label_position(t["label"], t["form"]) < F.size("_marked")))
    rows = rows.withColumn("_good", (F.size("_marked") > 0) & F.forall("_marked", lambda e: e["fmt"] == F.col("_form")) & fits & free)

    def one(e: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice("_both", F.lit(1), i), lambda p: (p["label"] == "") & (p["fmt"] != "")))
        return F.when((e["label"] == "") & (e["fmt"] != ""), make_label(before, F.col("_form"))).otherwise(e["label"])

    return rows.withColumn(out, F.when(F.col("_good"), F.transform("_both", one))).drop("_both", "_marked", "_form", "_typed", "_good")


def with_labels(df: DataFrame, labels: str, formats: str, default: Column, script: Column, out: str) -> DataFrame:
    """Labels after all rules: one entry or none missing, as they are; some missing, from automatic numbers, else by filling gaps; all missing, from the first in a format. Typed labels are never changed."""
    own = F.try_element_at(formats, F.lit(1))
    rows = df.withColumns({"_missing": F.size(F.filter(labels, lambda x: x == "")), "_default": F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(default), "_script": script})
    # Only where some labels are missing do markers and gaps matter; elsewhere the array is null, and so is all that is made of it.
    rows = rows.withColumn("_some", F.when((F.size(labels) >= 2) & (F.col("_missing") > 0) & (F.col("_missing") < F.size(labels)), F.col(labels)))
    rows = with_filled_gaps(with_marker_labels(rows, "_some", formats, "_from_markers"), "_some", "_filled")
    every = F.transform(labels, lambda x, i: make_label(i, F.col("_default"), F.col("_script")))
    made = F.when((F.size(labels) < 2) | (F.col("_missing") == 0), F.col(labels)).when(F.col("_missing") == F.size(labels), every).otherwise(F.coalesce("_from_markers", "_filled"))
    return rows.withColumn(out, made).drop("_missing", "_default", "_script", "_some", "_from_markers", "_filled")


def label_order(items: DataFrame) -> DataFrame:
    """``items(paper_id, q_idx, ord, label, lead, ...)`` with ``ord`` changed so that a full sequence typed out of order is in order. Leads keep their places.

    Only a question whose labels have one format, no repeats and no gaps is put in order. A question's items are one array: sorted by label and laid over
    the places in their order, so that what lies below is worked out once and not for each side of a join.
    """
    rest = [c for c in items.columns if c not in ("paper_id", "q_idx", "ord")]
    rows = items.groupBy("paper_id", "q_idx").agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("_all"))
    rows = rows.withColumn("_items", F.filter("_all", lambda x: F.coalesce(~x["lead"], F.lit(False))))
    rows = rows.withColumn("_forms", F.transform("_items", lambda x: label_format(x["label"])))
    rows = rows.withColumn("_roman", F.try_element_at(F.filter("_forms", is_roman), F.lit(1)))

    def settled(form: Column, x: Column) -> Column:
        return F.when(F.col("_roman").isNotNull() & form.isin("a", "A") & is_ambiguous(x["label"]), F.col("_roman")).otherwise(form)

    rows = rows.withColumn("_forms", F.zip_with("_forms", "_items", settled))
    rows = rows.withColumn("_places", F.zip_with("_items", "_forms", lambda x, form: label_position(x["label"], form)))
    n, forms = F.size("_items"), F.array_distinct("_forms")
    one = (F.size(forms) == 1) & F.try_element_at(forms, F.lit(1)).isNotNull() & F.forall("_places", lambda p: p >= 0)
    good = (n >= 2) & one & (F.size(F.array_distinct("_places")) == n) & (F.array_max("_places") - F.array_min("_places") + 1 == n)
    by_label = F.array_sort(F.zip_with("_places", "_items", lambda p, x: F.struct(p.alias("place"), x.alias("x"))))
    moved = F.zip_with(by_label, F.col("_items"), lambda s, x: s["x"].withField("ord", x["ord"]))
    leads = F.filter("_all", lambda x: F.coalesce(x["lead"], F.lit(True)))
    out = unpacked(rows, ["paper_id", "q_idx"], F.when(good, F.concat(moved, leads)).otherwise(F.col("_all")), k="_k", x="_x")
    return out.select(*[c if c in ("paper_id", "q_idx") else F.col("_x")[c].alias(c) for c in items.columns])
