"""Boxes (x1, y1, x2, y2) as arrays of doubles or structs, and the scores that compare them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't meet."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    tall = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * tall
    return F.when(both > 0, F.try_divide(both, area(a) + area(b) - both)).otherwise(F.lit(0.0))


def clamped(b: Column, width: int, height: int) -> Column:
    """b within a canvas, or null if nothing of it is there."""
    def within(i: int, most: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), b[i].cast("double")))

    out = F.array(within(0, width), within(1, height), within(2, width), within(3, height))
    return F.when((out[2] > out[0]) & (out[3] > out[1]), out)


def normalised(b: Column, width: int, height: int, digits: int = 4) -> Column:
    """b as shares of a canvas."""
    return F.array(*[F.bround(b[i] / (width if i % 2 == 0 else height), digits) for i in range(4)])


def oversize_factor(gold_area: Column, found_area: Column, strength: float = 0.75) -> Column:
    """1, or less where the box found is larger than the true region."""
    ratio = gold_area / F.greatest(F.lit(EPS), found_area)
    return F.when((gold_area > 0) & (found_area > gold_area), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(ratio, F.lit(strength))))).otherwise(F.lit(1.0))


def budget_factor(n_boxes: Column, budget: int = 3, penalty: float = 0.08) -> Column:
    """1, less a share for each box beyond the budget."""
    return F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), n_boxes - budget) * penalty)


def grounding_score(gold: Column, found: Column, *, same_label: bool = True, no_features: Column | None = None) -> Column:
    """The mean over true boxes of the best overlap with a box found, or null without true boxes.

    Both are arrays of struct(label, box, area). A place known to have no features scores 1 without boxes, else 0.5.
    """
    def best(g: Column) -> Column:
        fit = F.transform(F.filter(found, lambda p: (p["label"] == g["label"]) if same_label else F.lit(True)), lambda p: iou(g["box"], p["box"]) * oversize_factor(g["area"], area(p["box"])))
        return F.coalesce(F.array_max(fit), F.lit(0.0))

    total = F.aggregate(F.transform(gold, best), F.lit(0.0), lambda s, x: s + x)
    score = F.when(F.size(gold) > 0, total * budget_factor(F.size(found)) / F.size(gold))
    if no_features is None:
        return score
    return F.when(no_features, F.when(F.size(found) == 0, 1.0).otherwise(0.5)).otherwise(score)


def small_object_score(areas: Column, soft: float = 0.02, hard: float = 0.08) -> Column:
    """How plausible the sizes of small objects are: 1 up to soft, 0 from hard on, a ramp between; 12 % less for each beyond three. 1 without any."""
    each = F.transform(areas, lambda a: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (a - soft) / (hard - soft))))
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(areas)
    many = F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), F.size(areas) - 3) * 0.12)
    return F.when(F.size(areas) > 0, mean * many).otherwise(F.lit(1.0))


def box_error(label: Column, box: Column, at: Column) -> Column:
    """The first fault of one box of normalised grounding output, as item_N_fault, or null."""
    name = F.concat(F.lit("item_"), at.cast("string"))
    inside = F.forall(box, lambda x: x.between(-EPS, 1 + EPS))
    return (
        F.when(F.trim(F.coalesce(label, F.lit(""))) == "", F.concat(name, F.lit("_empty_label")))
        .when(box.isNull() | (F.size(box) != 4), F.concat(name, F.lit("_bad_bbox")))
        .when(~(F.coalesce(inside, F.lit(False)) & (box[0] < box[2] - EPS) & (box[1] < box[3] - EPS)), F.concat(name, F.lit("_bbox_range")))
    )


def grounding_error(text: Column) -> Column:
    """ok, or the first fault of a JSON list of {label, bbox}."""
    parsed = F.from_json(text, "array<struct<label:string,bbox:array<double>>>")
    faults = F.filter(F.transform(parsed, lambda x, i: box_error(x["label"], x["bbox"], i)), lambda x: x.isNotNull())
    return F.when(parsed.isNull(), F.lit("json_decode")).otherwise(F.coalesce(F.get(faults, F.lit(0)), F.lit("ok")))


def _kind(value: Column) -> Column:
    """What a VARIANT is: ARRAY, OBJECT, STRING, VOID (null) or the name of a simple type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def contract_error(answer: Column) -> Column:
    """The first fault of the boxes of an answer (a VARIANT object with boxes of label, bbox and confidence), or null.

    Every value is read once: what follows works on the parts that are read.
    """
    def parts(x: Column, i: Column) -> Column:
        raw = F.try_variant_get(x, "$.bbox", "array<variant>")
        box = F.when(F.size(raw) == 4, F.transform(raw, lambda v: F.try_variant_get(v, "$", "double")))
        sure = F.try_variant_get(x, "$.confidence", "variant")
        return F.struct(F.concat(F.lit("box_"), i.cast("string")).alias("name"), _kind(x).alias("kind"), box.alias("box"), F.when(sure.isNotNull(), _kind(sure)).alias("sure_kind"), F.try_variant_get(x, "$.confidence", "double").alias("sure"))

    def fault(x: Column) -> Column:
        b = x["box"]
        what = (
            F.when(x["kind"] != "OBJECT", "_not_object")
            .when(b.isNull(), "_bbox_shape")
            .when(F.exists(b, lambda v: v.isNull()), "_bbox_numeric")
            .when(~F.forall(b, lambda v: v.between(0.0, 1.0)), "_bbox_range")
            .when(~((b[0] < b[2]) & (b[1] < b[3])), "_bbox_order")
            .when(x["sure_kind"].isin("STRING", "ARRAY", "OBJECT"), "_confidence_type")
            .when(~x["sure"].between(0.0, 1.0), "_confidence_range")
        )
        return F.concat(x["name"], what)

    def whole(v: Column) -> Column:
        missing = v.isNull() | F.is_variant_null(v)
        listed = F.transform(F.array(F.try_variant_get(v, "$", "array<variant>")), lambda items: F.when(items.isNull(), F.lit("boxes_not_list")).otherwise(F.get(F.filter(F.transform(F.transform(items, parts), fault), lambda f: f.isNotNull()), F.lit(0))))
        return F.when(missing, F.lit("missing_boxes_key")).otherwise(listed[0])

    return F.transform(F.array(F.try_variant_get(answer, "$.boxes", "variant")), whole)[0]


# How pieces of JSON with boxes look in a text.
BOX_FRAGMENT = r"(?s)\{[^{}]*\"label\"[^{}]*\"bbox\"[^{}]*\}"
BOX_LIST = r"\[[\s\S]{10,8000}?\]"
BOXES_KEY = r"\"boxes\"\s*:\s*\[[\s\S]{0,8000}?\]"


def parsed_boxes(text: Column) -> Column:
    """array<struct(label, box)> of a text with JSON pieces: objects with a label and a bbox, then lists of such objects, and if there are none the lists of a boxes key.

    A box counts with a label that is a text and a bbox of four numbers; a piece that isn't JSON is passed over, and what
    several kinds of pieces hold counts for each.
    """
    def boxes_of(items: Column) -> Column:
        def one(x: Column) -> Column:
            raw = F.try_variant_get(x, "$.bbox", "array<variant>")
            label = F.try_variant_get(x, "$.label", "variant")
            return F.struct(F.when(_kind(label) == "STRING", F.try_variant_get(label, "$", "string")).alias("label"), F.when(F.size(raw) == 4, F.transform(raw, lambda v: F.try_variant_get(v, "$", "double"))).alias("box"))

        return F.filter(F.transform(items, one), lambda r: r["label"].isNotNull() & r["box"].isNotNull() & ~F.exists(r["box"], lambda v: v.isNull()))

    # Each search is left out where the text can't hold what it looks for.
    pieces = lambda needed, pattern: F.when(text.contains(needed), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    lists = lambda found: F.flatten(F.transform(found, lambda s: F.coalesce(F.try_variant_get(F.try_parse_json(s), "$", "array<variant>"), F.array().cast("array<variant>"))))
    singles = F.filter(F.transform(pieces('"bbox"', BOX_FRAGMENT), lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())
    first = F.concat(boxes_of(singles), boxes_of(lists(pieces('"bbox"', BOX_LIST))))
    keyed = F.transform(pieces('"boxes"', BOXES_KEY), lambda s: F.concat(F.lit("{"), s, F.lit("}")))
    others = F.flatten(F.transform(keyed, lambda s: F.coalesce(F.try_variant_get(F.try_parse_json(s), "$.boxes", "array<variant>"), F.array().cast("array<variant>"))))
    return F.transform(F.array(first), lambda f: F.when(F.size(f) > 0, f).otherwise(boxes_of(others)))[0]
