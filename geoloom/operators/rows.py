"""Chat rows for training: messages are array<struct<role, content: array<struct<type, text, image>>>>.

Everything is a projection over nested columns, so rows never move; only joins with file lists and counts shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T

PART = "struct<type:string,text:string,image:string>"
MESSAGES = f"array<struct<role:string,content:array<{PART}>>>"


def text_part(value: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), value.cast("string").alias("text"), F.lit(None).cast("string").alias("image"))


def image_part(path: Column) -> Column:
    return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), path.cast("string").alias("image"))


def message(role: str | Column, *parts: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.array(*parts).alias("content"))


def chat_row(images: Column, user: Column, assistant: Column, system: Column | None = None) -> Column:
    """messages of one exchange: the images and the user's text, the answer, and a system text where it isn't null."""
    asked = F.struct(F.lit("user").alias("role"), F.concat(F.transform(images, image_part), F.array(text_part(user))).alias("content"))
    pair = F.array(asked, message("assistant", text_part(assistant)))
    return pair if system is None else F.when(system.isNotNull(), F.concat(F.array(message("system", text_part(system))), pair)).otherwise(pair)


def parsed_messages(raw: Column) -> Column:
    """messages from JSON text in which a content is a text or a list of parts; null where it isn't a list.

    Both readings of the text are parsed, and each message takes the one that fits.
    """
    lists = F.from_json(raw, MESSAGES)
    plain = F.from_json(raw, "array<struct<role:string,content:string>>")
    return F.transform(plain, lambda m, i: F.struct(m["role"].alias("role"), F.coalesce(F.from_json(m["content"], f"array<{PART}>"), F.get(lists, i)["content"], F.array(text_part(m["content"]))).alias("content")))


def texts_of(messages: Column, role: str | None = None) -> Column:
    """All text parts in order, of one role or of all."""
    chosen = messages if role is None else F.filter(messages, lambda m: m["role"] == role)
    return F.flatten(F.transform(chosen, lambda m: F.transform(F.filter(m["content"], lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])))


def role_length(messages: Column, role: str) -> Column:
    """Characters of a role's messages: each message's text parts joined by line ends."""
    joined = F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.length(F.array_join(F.transform(F.filter(m["content"], lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")))
    return F.coalesce(F.aggregate(joined, F.lit(0), lambda s, n: s + n), F.lit(0))


def image_paths(messages: Column) -> Column:
    """Relative paths of image parts in order."""
    flat = F.flatten(F.transform(messages, lambda m: F.transform(F.filter(m["content"], lambda p: (p["type"] == "image") & p["image"].isNotNull()), lambda p: p["image"])))
    return F.coalesce(F.filter(flat, lambda x: ~x.rlike("^(https?://|/)")), F.array().cast("array<string>"))


def all_paths(messages: Column, listed: Column) -> Column:
    """Paths of messages and of the metadata, each once, in order of first appearance."""
    return F.array_distinct(F.concat(image_paths(messages), F.coalesce(listed, F.array().cast("array<string>"))))


def last_exchange(messages: Column) -> Column:
    """struct(system, user, assistant): the first system text, and the last user's and assistant's message."""
    last = lambda role: F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))
    return F.struct(F.get(texts_of(messages, "system"), F.lit(0)).alias("system"), last("user").alias("user"), last("assistant").alias("assistant"))


def user_payload(user: Column) -> Column:
    """struct(images, text) of a user's message: its images and its last text that isn't blank."""
    texts = F.transform(F.filter(user["content"], lambda p: (p["type"] == "text") & (F.trim(p["text"]) != "")), lambda p: p["text"])
    images = F.transform(F.filter(user["content"], lambda p: (p["type"] == "image") & p["image"].isNotNull()), lambda p: p["image"])
    return F.struct(images.alias("images"), F.try_element_at(texts, F.lit(-1)).alias("text"))


def overlong(messages: Column, most_user: int, most_total: int) -> Column:
    """Why a row is too long, or null: dropped_user_too_long goes before dropped_total_too_long; bounds of 0 don't count."""
    return too_long(role_length(messages, "user"), role_length(messages, "user") + role_length(messages, "assistant"), most_user, most_total)


def too_long(user: Column, total: Column, most_user: int, most_total: int) -> Column:
    """The same from the lengths themselves."""
    return F.when((user > most_user) & F.lit(most_user > 0), "dropped_user_too_long").when((total > most_total) & F.lit(most_total > 0), "dropped_total_too_long")


def rewritten(messages: Column, most: dict[str, int], default: int = 20_000) -> Column:
    """messages with every text part through the normalising chain, each role with its own length; messages without a role go."""
    def part(m: Column):
        def one(p: Column) -> Column:
            out = T.normalised_text(p["text"], default)["text"]
            for role, n in most.items():
                out = F.when(m["role"] == role, T.normalised_text(p["text"], n)["text"]).otherwise(out)
            return F.struct(p["type"].alias("type"), F.when(p["type"] == "text", out).otherwise(p["text"]).alias("text"), p["image"].alias("image"))

        return one

    return F.transform(F.filter(messages, lambda m: F.trim(m["role"]) != ""), lambda m: F.struct(m["role"].alias("role"), F.transform(m["content"], part(m)).alias("content")))


def final_text(value: Column, role: Column) -> Column:
    """A text's last pass by role: answers lose markdown and get readable labels, prompts too; system texts stay."""
    tidy = T.readable_labels(T.without_markdown(value))
    return F.when(role.isin("user", "assistant"), F.trim(F.regexp_replace(tidy, r"\n{3,}", "\n\n"))).otherwise(value)


def with_media_tag(messages: Column, tag: str) -> Column:
    """messages whose image paths have a tag behind their first folder."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.transform(m["content"], lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.when(p["image"].isNotNull(), T.namespaced(p["image"], tag)).alias("image"))).alias("content")))


def remapped(rows: DataFrame, key: str, paths: str, moves: DataFrame) -> DataFrame:
    """rows with the paths in an array column replaced by a table (old, new); paths without an entry stay, in order."""
    exploded = rows.select(key, F.posexplode(paths).alias("pos", "old"))
    found = exploded.join(moves.select("old", "new"), "old", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "old").alias("p")))).alias("__p"))  # a row has a handful of paths
    return rows.join(found, key, "left").withColumn(paths, F.coalesce(F.transform("__p", lambda e: e["p"]), F.col(paths))).drop("__p")


def media_complete(rows: DataFrame, key: str, paths: str, files: DataFrame) -> DataFrame:
    """rows all of whose paths are among the files (column path); rows without paths stay."""
    missing = rows.select(key, F.explode(F.array_distinct(paths)).alias("path")).join(files.select("path"), "path", "left_anti").select(key).distinct()
    return rows.join(missing, key, "left_anti")


def canonical(rows: DataFrame, default_task: str = "sft", default_split: str = "train") -> DataFrame:
    """messages, metadata and _postprocess in their fixed shape, from rows with messages and a metadata struct of texts.

    Blank fields take their defaults: the event's id for a missing sample id, profile for analysis_profile; paths come from the messages where none are listed.
    """
    have = {f.name for f in rows.schema["metadata"].dataType.fields}

    def field(*names: str, default: str = "") -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.col(f"metadata.{n}").cast("string")), F.lit("")) for n in names if n in have], F.lit(default))

    listed = F.col("metadata.image_paths") if "image_paths" in have else F.lit(None).cast("array<string>")
    paths = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(image_paths(F.col("messages")))
    flag = lambda n: F.coalesce(F.col(f"_postprocess.{n}"), F.lit(True)) if "_postprocess" in rows.columns else F.lit(True)
    meta = F.struct(
        field("sample_id", "event_id").alias("sample_id"), field("task", default=default_task).alias("task"), field("analysis_profile", "profile").alias("analysis_profile"),
        field("tile_stem").alias("tile_stem"), field("split", default=default_split).alias("split"), paths.alias("image_paths"), field("analysis_image_path").alias("analysis_image_path"),
    )
    messages = F.coalesce(F.col("messages"), F.array().cast(MESSAGES))
    return rows.select(messages.alias("messages"), meta.alias("metadata"), F.struct(flag("minify").alias("minify"), flag("final_pass").alias("final_pass")).alias("_postprocess"))


def prompt_blob(messages: Column) -> Column:
    """All texts of a row, a line each."""
    return F.array_join(texts_of(messages), "\n")


def drop_reason(blob: Column, most_chars: int = 16_000) -> Column:
    """Why a row of this text goes: bloat by a banned string, prompt_too_long, or null."""
    return T.let(F.struct(blob.alias("t"), T.first_banned(blob, T.BLOAT).alias("bad")), lambda x: F.when(x["bad"].isNotNull(), F.concat(F.lit("bloat:"), x["bad"])).when(F.length(x["t"]) > most_chars, "prompt_too_long"))


def gated(rows: DataFrame, most_chars: int = 16_000) -> DataFrame:
    """rows with drop_reason."""
    return rows.withColumn("drop_reason", drop_reason(prompt_blob(F.col("messages")), most_chars))


def gated_turns(turns: DataFrame, most_chars: int = 16_000) -> DataFrame:
    """(conv_id, drop_reason) of turns (conv_id, text), as an aggregate that needs no conversation in one row: no banned string spans two turns."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = [F.max(low.contains(b)).alias(f"b{i}") for i, b in enumerate(T.BLOAT)]
    sums = turns.groupBy("conv_id").agg(*found, (F.sum(F.length(F.coalesce("text", F.lit("")))) + F.count("*") - 1).alias("chars"))
    bad = F.coalesce(*[F.when(F.col(f"b{i}"), F.lit(f"bloat:{b}")) for i, b in enumerate(T.BLOAT)])
    return sums.select("conv_id", F.coalesce(bad, F.when(F.col("chars") > most_chars, "prompt_too_long")).alias("drop_reason"))


def last_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, system, user, assistant) of turns (conv_id, turn, role, text): the first system text, and the text of the last user's and assistant's turn (null if that is blank), as an aggregate."""
    place, text = F.struct("turn", "role", "text"), F.coalesce("text", F.lit(""))
    of = lambda role, x: F.when(F.col("role") == role, x)
    last = lambda role: F.max_by(F.when(F.trim(text) != "", text), of(role, place)).alias(role)
    return turns.groupBy("conv_id").agg(F.min_by(text, of("system", place)).alias("system"), last("user"), last("assistant"))


def gated_sidecar_rows(rows: DataFrame, leaked: DataFrame, split: str = "all", most_chars: int = 16_000) -> DataFrame:
    """rows (stem, split, task, prompt, answer) with drop_reason: leaked_base, other_split, missing_image, bloat, prompt_too_long, a fault of a grounding answer, or null.

    leaked: the bases (column base) that another split holds too. Rows with a null image column are missing one.
    """
    marked = rows.withColumn("__base", T.base_id(F.col("stem"))).join(leaked.select(F.col("base").alias("__base"), F.lit(True).alias("__leaked")).distinct(), "__base", "left")
    fault = F.when(F.col("task").isin("grounding", "per_class_grounding"), B.grounding_error(F.col("answer")))
    image = F.when(F.col("image").isNull(), "missing_image") if "image" in rows.columns else F.lit(None).cast("string")
    other = F.when(F.col("split") != split, "other_split") if split != "all" else F.lit(None).cast("string")
    why = F.coalesce(F.when(F.col("__leaked"), "leaked_base"), other, image, drop_reason(F.concat_ws("\n", "prompt", "answer"), most_chars), F.when(fault != "ok", F.concat(F.lit("grounding:"), fault)))
    return marked.withColumn("drop_reason", why).drop("__base", "__leaked")


def drop_counts(gated_rows: DataFrame) -> DataFrame:
    """(task, reason, n) of gated rows; what stays counts as kept."""
    return gated_rows.groupBy("task", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# The tasks, and names that stand for several.
TASKS = ["production_analysis", "caption", "grounding", "per_class_grounding", "per_class_focus", "absence", "cross_view"]
TASK_ALIASES = {"per_class": ["per_class_grounding", "per_class_focus"], "analysis": ["production_analysis"]}


def wanted_tasks(mix: list[str]) -> list[str]:
    """The tasks that a mix of names stands for, in the fixed order."""
    if "all" in mix:
        return TASKS
    named = {t for m in mix for t in TASK_ALIASES.get(m, [m])}
    return [t for t in TASKS if t in named]


def sidecar_rows(sidecars: DataFrame, tasks: list[str], profiles: list[str]) -> DataFrame:
    """A row for each task of each sidecar that supports it: (stem, task, profile, label, prompt, answer).

    sidecars: stem, caption, fractions map<int,double>, regions array<struct<label,box>> with boxes as shares of the tile, present_ids, overhead path or null.
    A grounding answer is a JSON list of {label, bbox}, which boxes.grounding_error checks. The tasks of a sidecar are one array that is exploded, so the sidecars are read once.
    """
    from . import pixels as P

    def row(task: str, when: Column, prompt: Column, answer: Column, profile: Column | None = None, label: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.when(when, F.struct(F.lit(task).alias("task"), (none if profile is None else profile).alias("profile"), (none if label is None else label).alias("label"), prompt.alias("prompt"), answer.alias("answer")))

    top = P.dominant_classes(F.col("fractions"))
    summary = F.array_join(F.transform(top, lambda e: F.concat(e["label"], F.lit(" "), F.bround(e["fraction"] * 100, 1).cast("string"), F.lit("%"))), ", ")
    gone = P.raster.land_cover_name(P.absent_class(F.col("fractions"), F.col("present_ids")))
    regions = F.coalesce(F.col("regions"), F.array().cast("array<struct<label:string,box:array<double>>>"))
    labels = F.transform(regions, lambda r: r["label"])
    listed = lambda rs: F.to_json(F.transform(rs, lambda r: F.struct(r["label"].alias("label"), F.transform(r["box"], lambda v: F.bround(v, 4)).alias("bbox"))))
    always = F.col("caption").isNotNull()
    made: list[Column] = []
    if "production_analysis" in tasks:
        made += [F.array(row("production_analysis", F.size(top) > 0, F.lit(f"Analyse the scene for {p}."), summary, F.lit(p))) for p in profiles]
    if "caption" in tasks:
        made.append(F.array(row("caption", always, F.lit("Describe the scene."), F.col("caption"))))
    if "grounding" in tasks:
        made.append(F.array(row("grounding", F.size(regions) > 0, F.lit("Locate the regions."), listed(regions))))
    if "per_class_grounding" in tasks:
        made.append(F.transform(F.array_distinct(labels), lambda x: row("per_class_grounding", F.lit(True), F.concat(F.lit("Locate "), x, F.lit(".")), listed(F.filter(regions, lambda r: r["label"] == x)), label=x)))
    if "per_class_focus" in tasks:
        made.append(F.transform(top, lambda e: row("per_class_focus", e["fraction"] >= 0.05, F.concat(F.lit("Describe only "), e["label"], F.lit(" in the imagery:")), P.focus_sentence(e["label"], e["fraction"], F.size(F.filter(labels, lambda x: x == e["label"]))), label=e["label"])))
    if "absence" in tasks:
        made.append(F.array(row("absence", gone.isNotNull(), F.concat(F.lit("Is there any "), gone, F.lit("?")), F.concat(F.lit("No clear "), gone, F.lit(" is visible.")), label=gone)))
    if "cross_view" in tasks:
        made.append(F.array(row("cross_view", F.col("overhead").isNotNull() & always, F.lit("Relate both views."), F.col("caption"))))
    return sidecars.select("stem", F.explode(F.array_compact(F.concat(*made))).alias("r")).select("stem", "r.*")


#: Prompts of tile and pair rows; {target} and {class_name} are filled in. Callers give their own.
PROMPTS = {"caption": "Describe this satellite image.", "grounding": "Find {target} and give their boxes as JSON.", "focus": "Describe {class_name} in this satellite image."}
# What the grounding of all regions asks for, and which classes of a tile have rows of their own.
ALL_REGIONS = "land cover regions visible in this satellite imagery"
LEAST_SHARE, MOST_CLASSES = 0.05, 9


def boxes_json(regions: Column, width: int, height: int, *, scores: bool = False) -> Column:
    """A JSON list of {label, bbox} of regions (label, box in pixels), as shares of the image to four digits; with score, to four digits, where scores and a region has one."""
    sides = (width, height, width, height)
    box = lambda r: F.array(*[F.bround(r["box"][i] / F.lit(float(max(1, n))), 4) for i, n in enumerate(sides)]).alias("bbox")
    more = lambda r: [F.bround(r["score"].cast("double"), 4).alias("score")] if scores else []
    return F.to_json(F.transform(regions, lambda r: F.struct(r["label"].alias("label"), box(r), *more(r))))


def tile_rows(tiles: DataFrame, *, size: int, prompts: dict[str, str] | None = None, grounding: bool = True, by_class: bool = True, class_grounding: bool = True, least: float = LEAST_SHARE, most: int = MOST_CLASSES) -> DataFrame:
    """The training rows of each tile: (stem, split, tag, image, user, assistant).

    tiles: stem, split, caption, fractions map<int,double> and regions array<struct<class_id, label, box, area_px>>, boxes in pixels of an image of size by size. There is a caption row; one that
    grounds all regions, if there are any; and, for the most classes of the greatest shares that have the least share at least (ties by id), a row on each class and one that grounds its
    regions, if it has any. A null caption gives an empty answer, null regions or fractions are none. A tile's rows are one array that is exploded.
    """
    from . import pixels as P

    asked = PROMPTS | (prompts or {})
    regions = F.coalesce("regions", F.array().cast("array<struct<class_id:int,label:string,box:array<int>,area_px:int>>"))
    known = F.filter(F.map_entries(F.coalesce("fractions", F.create_map().cast("map<int,double>"))), lambda e: e["key"].between(0, len(P.raster.LAND_COVER) - 1))
    ranked = F.slice(F.array_sort(F.transform(known, lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("id")))), 1, most)
    of = lambda tag, user, answer: F.struct(tag.alias("tag"), user.alias("user"), answer.alias("assistant"))

    def filled_in(kind: str, field: str, value: Column) -> Column:
        before, _, after = asked[kind].partition("{" + field + "}")
        return F.concat(F.lit(before), value, F.lit(after))

    def of_class(e: Column) -> Column:
        name, own = P.raster.land_cover_name(e["id"]), F.filter(regions, lambda r: r["class_id"] == e["id"])
        focus = of(F.concat(F.lit("classfocus_"), name), filled_in("focus", "class_name", name), P.focus_sentence(name, -e["o"], F.size(own)))
        ground = of(F.concat(F.lit("ground_"), name), filled_in("grounding", "target", F.replace(name, F.lit("_"), F.lit(" "))), boxes_json(own, size, size))
        return F.array(focus, F.when(F.lit(grounding and class_grounding) & (F.size(own) > 0), ground))

    made = [F.array(of(F.lit("caption"), F.lit(asked["caption"]), F.coalesce("caption", F.lit(""))))]
    if grounding:
        made.append(F.array(F.when(F.size(regions) > 0, of(F.lit("ground_all"), filled_in("grounding", "target", F.lit(ALL_REGIONS)), boxes_json(regions, size, size)))))
    if by_class:
        made.append(F.flatten(F.transform(F.filter(ranked, lambda e: -e["o"] >= least), of_class)))
    rows = tiles.select("stem", "split", F.explode(F.array_compact(F.concat(*made))).alias("r"))
    return rows.select("stem", "split", "r.tag", F.concat(F.lit("images/"), F.col("stem"), F.lit(".png")).alias("image"), "r.user", "r.assistant")


def pair_rows(pairs: DataFrame, *, size: int, system: str, prompts: dict[str, str] | None = None) -> DataFrame:
    """The training rows of pairs of images: (key, split, tag, row): a chat row with a caption, and one that grounds the changed regions, if there are any.

    pairs: key, split, images array<string>, caption and regions array<struct<label, box, area_px, score>>, boxes in pixels. Null regions are none, a null caption is empty.
    """
    asked = PROMPTS | (prompts or {})
    regions = F.coalesce("regions", F.array().cast("array<struct<label:string,box:array<int>,area_px:int,score:double>>"))
    row = lambda user, answer: chat_row(F.col("images"), F.lit(user), answer, F.lit(system))
    caption = F.struct(F.lit("caption").alias("tag"), row(asked["caption"], F.coalesce("caption", F.lit(""))).alias("row"))
    ground = F.struct(F.lit("grounding").alias("tag"), row(asked["grounding"].replace("{target}", "the changed regions"), boxes_json(regions, size, size, scores=True)).alias("row"))
    made = F.array_compact(F.array(caption, F.when(F.size(regions) > 0, ground)))
    return pairs.select("key", "split", F.explode(made).alias("r")).select("key", "split", "r.tag", "r.row")


def first_images(rows: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """(base, first_pos, hint): for each base the place where it first occurs and an image of it, one under images/ before others."""
    cols = rows.select(base.alias("base"), F.struct(*order).alias("pos"), "path")
    return cols.groupBy("base").agg(F.min("pos").alias("first_pos"), F.min_by("path", F.struct((~F.col("path").startswith("images/")).alias("p"), "pos", "path")).alias("hint"))


def shard_paths(stems: DataFrame, shards: int, hint: Column) -> DataFrame:
    """(stem, pos, path): the places where a stem's sidecar can be: the shard hinted at, all shards in order, and none."""
    name = F.concat(F.col("stem"), F.lit(".json"))
    hinted = F.when(hint.isNotNull(), F.array(F.concat_ws("/", F.lit("metadata"), hint, name))).otherwise(F.array().cast("array<string>"))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.concat_ws("/", F.lit("metadata"), F.format_string("s%05d", i), name))
    return stems.select("stem", F.posexplode(F.array_distinct(F.concat(hinted, everywhere, F.array(F.concat_ws("/", F.lit("metadata"), name))))).alias("pos", "path"))


def mixed_findings(rows: DataFrame, key: str, findings: str, seed: str, least: int = 2, most: int = 4) -> DataFrame:
    """rows with a choice of their findings: between least and most of them, picked and ordered by a hash of seed, key and text."""
    h = lambda *x: F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), *x), 256)
    size = F.lit(least) + F.pmod(F.conv(F.substring(h(F.lit("n")), 1, 8), 16, 10).cast("long"), F.lit(most - least + 1)).cast("int")
    ordered = F.transform(F.array_sort(F.transform(findings, lambda x: F.struct(h(x).alias("o"), x.alias("x")))), lambda e: e["x"])
    return rows.withColumn(findings, F.slice(ordered, F.lit(1), size))


def turn_lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, user_chars, assistant_chars): role_length() as an aggregate over turns (conv_id, role, text), which needs no conversation in one row."""
    n = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.length("text"))), F.lit(0))
    return turns.groupBy("conv_id").agg(n("user").alias("user_chars"), n("assistant").alias("assistant_chars"))
