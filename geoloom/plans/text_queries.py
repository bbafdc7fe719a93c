"""Queries over texts and chats: checks, rewriting, lengths, rows for training, and scores of captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import geo, matching
from ..functions import text as T
from ..operators import pixels as P
from ..operators import rows as R
from ..operators import scoring as S
from . import tables as t


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t.spread(t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with numbers, places and marks, from line items."""
    i = t.spread(t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity"))
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = F.concat(
        F.lit("Water covers "), F.format_string("%.1f", F.col("l_discount") * 400), F.lit("% and trees "), F.col("l_quantity").cast("int").cast("string"), F.lit("%. ISO country: no. "),
        F.when(k % 3 == 0, F.lit("Vicinity: some street 5. ")).otherwise(""), F.when(k % 4 == 0, F.lit("The scene is centered near 52.44480°, -8.92879°. ")).otherwise(""), F.lit("**Built** and `crops` at latitude x."),
    )
    return i.select(k.alias("k"), text.alias("text"))


def coordinate_literals(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(T.has_coordinates(F.col("text"))).select("doc_id")


def banned_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.first_banned(F.col("text"), ["password", "secret", "The"]).alias("hit")).where("hit is not null")


def caption_violations(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(T.caption_violations(F.col("text"), most=400, banned=["license"]), ",").alias("codes"))


def style_violations(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).select("doc_id", T.style_violations(F.col("text")).alias("v"))
    return x.select("doc_id", F.array_join("v", ",").alias("codes"), T.should_retry(F.col("v")).alias("retry"))


def coarse_percentages(spark: SparkSession, d: str) -> DataFrame:
    x = _numbers(spark, d).select("k", T.coarse_percentages(F.col("text")).alias("r"))
    return x.select("k", "r.text", F.col("r.n").cast("long").alias("n"))


def redacted_places(spark: SparkSession, d: str) -> DataFrame:
    x = _numbers(spark, d).select("k", T.redacted_places(F.col("text")).alias("r"))
    return x.select("k", "r.text", F.col("r.n").cast("long").alias("n"))


def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    x = _numbers(spark, d).select("k", T.normalised_text(F.col("text"), 90).alias("r"))
    return x.select("k", "r.text", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("location_redacted", "percent_deprecision", "assistant_trimmed", "coord_kw_remaining")])


def readable_texts(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).select("k", T.readable_labels(T.without_markdown(F.col("text"))).alias("text"))


def capped_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.capped(F.col("text"), 60).alias("text"))


def boundary_cuts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.cut_at_boundary(F.col("text"), 200).alias("cut"), T.leading_sentences(F.col("text"), 300).alias("lead"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


def page_prose(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "pages")
    return p.select("page_id", F.length(T.plain_prose(F.regexp_replace("html", "<[^>]*>", " "))).cast("long").alias("chars"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


def template_fill(spark: SparkSession, d: str) -> DataFrame:
    n = t.table(spark, d, "nation")
    facts = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), T.filled("Country {name} ({key}) {missing}has a long story to tell.", facts, 40).alias("text"))


def etags(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.etag(F.col("text")).alias("etag"))


def media_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.element_at(F.array(F.lit("images/"), F.lit("stills/"), F.lit("other/"), F.lit("images/tag/")), (F.col("l_linenumber") % 4 + 1)), F.col("l_orderkey").cast("string"))
    return t.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), T.namespaced(path, "tag").alias("path"))


def fallback_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("org__set/images/"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("images/"), F.col("c_custkey").cast("string")))
    return t.table(spark, d, "customer").select("c_custkey", F.posexplode(T.path_candidates(path)).alias("pos", "path")).select("c_custkey", F.col("pos").cast("long").alias("pos"), "path")


def term_matches(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(T.matched_terms(F.col("text"), ["the", "open source", "license", "sea"]), ",").alias("terms"))


def chat_lengths(spark: SparkSession, d: str) -> DataFrame:
    x = R.turn_lengths(t.table(spark, d, "conversations"))
    why = R.too_long(F.col("user_chars"), F.col("user_chars") + F.col("assistant_chars"), 300, 600)
    return x.select("*", F.coalesce(why, F.lit("kept")).alias("why"))


def turn_lengths(spark: SparkSession, d: str) -> DataFrame:
    return R.turn_lengths(t.table(spark, d, "conversations"))


def last_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return R.last_texts(t.table(spark, d, "conversations"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders")
    k = F.col("o_orderkey")
    images = F.array(F.concat(F.lit("images/"), k.cast("string"), F.lit(".png")), F.when(k % 3 == 0, F.lit("https://x.test/a.png")).otherwise(F.lit("stills/b.png")))
    messages = R.chat_row(images, F.concat(F.lit("Describe "), F.col("o_orderpriority")), F.lit("Fine."), F.when(k % 2 == 0, F.lit("Be brief.")))
    meta = F.struct(F.when(k % 4 != 0, k.cast("string")).alias("sample_id"), F.concat(F.lit("e"), k.cast("string")).alias("event_id"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("task"), F.lit("wildfire").alias("profile"), F.array().cast("array<string>").alias("image_paths"))
    return o.select(k.alias("k"), messages.alias("messages"), meta.alias("metadata"))


def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    c = R.canonical(_rows(spark, d))
    return c.select(F.col("metadata.sample_id").alias("sample_id"), F.col("metadata.task").alias("task"), F.col("metadata.analysis_profile").alias("profile"), F.col("metadata.split").alias("split"), F.array_join("metadata.image_paths", "|").alias("paths"), F.size("messages").cast("long").alias("n"))


def row_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.gated_turns(t.table(spark, d, "conversations"), 900).select("conv_id", F.coalesce("drop_reason", F.lit("kept")).alias("why"))


def media_complete(spark: SparkSession, d: str) -> DataFrame:
    x = _rows(spark, d).select("k", R.image_paths(F.col("messages")).alias("paths"))
    files = x.where("k % 7 != 0").select(F.explode("paths").alias("path")).distinct()
    return R.media_complete(x, "k", "paths", files).select("k")


def path_remap(spark: SparkSession, d: str) -> DataFrame:
    x = _rows(spark, d).select("k", R.image_paths(F.col("messages")).alias("paths"))
    moves = x.where("k % 2 = 0").select(F.explode("paths").alias("old")).distinct().select("old", F.concat(F.lit("moved/"), "old").alias("new"))
    return R.remapped(x, "k", "paths", moves).select("k", F.array_join("paths", "|").alias("paths"))


def _sidecars(spark: SparkSession, d: str) -> DataFrame:
    o = t.spread(t.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"))
    k = F.col("o_orderkey")
    fr = F.map_from_arrays(F.array(F.lit(0), F.lit(1), F.lit(6)), F.array((k % 3).cast("double"), F.lit(1.0), (k % 2).cast("double")))
    box = lambda label, x2: F.struct(F.lit(label).alias("label"), F.array(F.lit(0.25), F.lit(0.5), x2, F.lit(1.0)).alias("box"))
    regions = F.when(k % 2 == 0, F.array(box("water", (k % 4) / 4 + 0.25), box("trees", F.lit(0.75)))).otherwise(F.array().cast("array<struct<label:string,box:array<double>>>"))
    return o.select(F.format_string("poi_%06d_g1", k).alias("stem"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("caption"), fr.alias("fractions"), regions.alias("regions"), F.array(F.lit(0), F.lit(1)).alias("present_ids"), F.when(k % 3 == 0, F.lit("mb.png")).alias("overhead"), k.alias("k"))


def sidecar_tasks(spark: SparkSession, d: str) -> DataFrame:
    x = R.sidecar_rows(_sidecars(spark, d), R.wanted_tasks(["all"]), ["wildfire", "brief_only"])
    return x.groupBy("task", "profile", "label").agg(F.count("*").alias("n"), F.min("answer").alias("example"))


def sidecar_drops(spark: SparkSession, d: str) -> DataFrame:
    s = _sidecars(spark, d)
    x = R.sidecar_rows(s, R.wanted_tasks(["caption", "grounding", "cross_view"]), []).withColumn("split", F.lit("train"))
    leaked = s.where("k % 7 = 0").select(T.base_id(F.col("stem")).alias("base"))
    return R.drop_counts(R.gated_sidecar_rows(x, leaked, most_chars=126))


def lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    s = S.lexical_score(F.col("text"), [["the", "der"], ["water", "river"], ["and"]], ["password"], ["license"], 20)
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", "s.score", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("groups_hit", "forbidden", "risky", "words")])


def class_claims(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(S.class_claims(F.col("text")), ",").alias("claims"), S.hedged(F.col("text")).alias("hedged"), F.array_join(S.leaks(F.col("text")), ",").alias("leaks"))


#: Fenced blocks of answers, whole and broken in every way that their form can be.
_BLOCKS = (
    "{not json", '{"other": []}', '{"boxes": 3}', '{"boxes": null}', '{"boxes": []}', '{"boxes": [4]}', '{"boxes": [{"label": "a", "bbox": [0.1, 0.2, 0.3]}]}', '{"boxes": [{"label": "a", "bbox": [0.1, "x", 0.3, 0.4]}]}',
    '{"boxes": [{"label": "a", "bbox": [0.1, 0.2, 1.4, 0.5]}]}', '{"boxes": [{"bbox": [0, 0, 1, 1]}, {"bbox": [0.5, 0.2, 0.4, 0.5]}]}', '{"boxes": [{"bbox": [0, 0, 1, 1], "confidence": "high"}]}', '{"boxes": [{"bbox": [0, 0, 1, 1], "confidence": 1.5}]}',
    '{"boxes": [{"label": "sea", "bbox": [0.1, 0.2, "0.4", 0.5], "confidence": 0.9}]}', "[1]", '{"boxes": [{"label": "a", "bbox": [0.1, 0.2, 0.3, 0.4]}]}',
)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a fenced block, some of them broken in one way or another, from line items."""
    i = t.spread(t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    body = F.element_at(F.array(*[F.lit(x) for x in _BLOCKS]), (k % len(_BLOCKS) + 1).cast("int"))
    prose = F.when(k % 7 == 0, F.lit("Short text.")).otherwise(F.concat(F.lit("The water covers about "), F.col("l_quantity").cast("int").cast("string"), F.lit("% of a scene with trees, roads and an uncertain glacier far behind the town.")))
    text = F.when(k % 11 == 0, prose).when(k % 13 == 0, F.concat(F.lit("[boxes] "), prose)).otherwise(F.concat(prose, F.lit("\n```json\n"), body, F.lit("\n```")))
    return i.select(k.alias("k"), text.alias("caption"))


def contract_scores(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("k", S.contract_score(F.col("caption")).alias("c")).select("k", "c.score", "c.verdict", "c.error")


def document_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as captions of a scene with water and trees."""
    k = F.col("doc_id")
    profile = F.element_at(F.array(F.lit("wildfire"), F.lit(S.VESSEL_PROFILE), F.lit("brief_only")), (k % 3 + 1).cast("int"))
    score = S.faithfulness_score(F.col("text"), F.create_map(F.lit("water"), F.lit(30.0), F.lit("trees"), F.lit(10.0)), k % 4 != 0, profile=profile, vessels=k % 2)
    return _docs(spark, d).select("doc_id", score.alias("score"))


def faithfulness_scores(spark: SparkSession, d: str) -> DataFrame:
    shares = F.when(F.col("k") % 6 != 0, F.create_map(F.lit("water"), F.lit(30.0), F.lit("trees"), F.lit(10.0)))
    return _answers(spark, d).select("k", S.faithfulness_score(F.col("caption"), shares, F.col("k") % 4 != 0).alias("score"))


def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    r = t.results(spark, d)
    c = S.composite(F.col("lexical"), F.col("grounding"), F.col("pass_value") / 2, F.col("composite"), forbidden=(F.col("part") % 3).cast("int"), risky=F.lit(1), found_boxes=F.col("part") % 4, leaked=F.col("part") % 17 == 0)
    return r.select("model", c.alias("score")).groupBy("model").agg(F.count("score").alias("n"), F.round(F.avg("score"), 3).alias("mean"))


def label_names(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "part")
    return p.select("p_partkey", S.canonical_label(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Open Ocean ", "pine forest", "ROCK face", "ice", "harbor ", "zzz")]), (F.col("p_partkey") % 6 + 1).cast("int")))).alias("label"))


def grounding_errors(spark: SparkSession, d: str) -> DataFrame:
    x2 = F.when(F.col("c_custkey") % 3 == 0, "1.7").when(F.col("c_custkey") % 3 == 1, "0.05").otherwise("0.9")
    text = F.when(F.col("c_custkey") % 10 == 0, F.lit("oops")).otherwise(F.concat(F.lit('[{"label": "a", "bbox": [0.1, 0.2, 0.3, 0.4]}, {"label": "'), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise("b"), F.lit('", "bbox": [0.1, 0.2, '), x2, F.lit(", 0.9]}]")))
    return t.table(spark, d, "customer").select("c_custkey", B.grounding_error(text).alias("error"))


def small_object_scores(spark: SparkSession, d: str) -> DataFrame:
    areas = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 6).cast("int") + 1), lambda i: (F.col("c_custkey") % 10 + i) / F.lit(100.0))
    return t.table(spark, d, "customer").select("c_custkey", F.round(B.small_object_score(areas), 6).alias("score"))


def caption_changes(spark: SparkSession, d: str) -> DataFrame:
    b = t.table(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.concat_ws(" ", F.col("text"), F.lit("and so on")).alias("other"))
    both = b.join(other, "item_id", "left").withColumn("other", F.coalesce("other", "text"))
    return both.select("item_id", S.responsiveness(F.concat_ws(" ", "text", "other"), F.col("other")).alias("responsiveness"))


def caption_responsiveness(spark: SparkSession, d: str) -> DataFrame:
    """Each text against its damaged form: how much a change is answered, by matching blocks."""
    b = t.table(spark, d, "benchmark").select("item_id", "text", F.regexp_replace("text", r"(\w+) (\w+) (\w+)", "$2 $1").alias("other"))
    return t.spread(b).select("item_id", matching.changed_by(F.col("text"), F.col("other")).alias("responsiveness"))


def focus_sentences(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    name = P.raster.land_cover_name(F.col("c_custkey") % 9)
    return c.select("c_custkey", P.focus_sentence(name, (F.col("c_custkey") % 8) / F.lit(8.0), F.col("c_custkey") % 7).alias("text"))


def mixed_findings(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer").select("c_custkey", F.array(*[F.lit(x) for x in "abcdef"]).alias("f"))
    return R.mixed_findings(c, "c_custkey", "f", "mix").select("c_custkey", F.array_join("f", "").alias("picked"))


def hash_labels(spark: SparkSession, d: str) -> DataFrame:
    fr = F.create_map(F.lit(0), F.lit(0.25), F.lit(1), F.lit(0.5), F.lit(7), F.lit(0.25))
    u = geo.hash_uniform(F.lit("label"), F.col("c_custkey"))
    return t.table(spark, d, "customer").select(P.picked_class(fr, u).cast("long").alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    coordinate_literals, banned_words, caption_violations, style_violations, coarse_percentages, redacted_places, normalised_texts, readable_texts, capped_texts, boundary_cuts, word_counts, page_prose, safe_names,
    template_fill, etags, media_paths, fallback_paths, term_matches, chat_lengths, turn_lengths, last_exchanges, canonical_rows, row_gate, media_complete, path_remap, sidecar_tasks, sidecar_drops, lexical_scores, class_claims,
    contract_scores, faithfulness_scores, document_faithfulness, composite_scores, label_names, grounding_errors, small_object_scores, caption_changes, caption_responsiveness, focus_sentences, mixed_findings, hash_labels,
)}

_D = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_K = "l_orderkey * 10 + l_linenumber"
_N = f"""(SELECT {_K} AS k, 'Water covers ' || printf('%.1f', l_discount * 400) || '% and trees ' || l_quantity::INT || '%. ISO country: no. ' || CASE WHEN ({_K}) % 3 = 0 THEN 'Vicinity: some street 5. ' ELSE '' END || CASE WHEN ({_K}) % 4 = 0 THEN 'The scene is centered near 52.44480°, -8.92879°. ' ELSE '' END || '**Built** and `crops` at latitude x.' AS text,
  l_discount * 400 AS p, l_quantity::INT AS q FROM lineitem)"""
_Q = lambda v: f"(CASE WHEN {v} < 1 THEN '<1%' WHEN {v} < 3 THEN '~2%' ELSE '~' || greatest(5, least(100, (round_even({v} / 5, 0) * 5)::INT)) || '%' END)"
_RED = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, 'centered near\s+[-+]?\d+(?:\.\d+)?°\s*,\s*[-+]?\d+(?:\.\d+)?°\.?', 'centered near an unspecified location.', 'gi'), '\bISO country:\s*[A-Z]{{2}}\.?', '', 'gi'), '\bVicinity:\s*[^.\n]{{1,200}}\.?', '', 'gi')"
_CLAIM = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(l, '{w}')''' for w in words)} THEN '{name}' END" for name, words in S.CLASS_WORDS.items())
_C = "(SELECT conv_id, role, coalesce(text, '') AS text, turn FROM conversations)"
_LAST = lambda role: f"arg_max(CASE WHEN trim(text, ' ') != '' THEN text END, turn) FILTER (role = '{role}')"
_IM = "(SELECT o_orderkey AS k, 'images/' || o_orderkey || '.png' AS a, CASE WHEN o_orderkey % 3 != 0 THEN 'stills/b.png' END AS b, * FROM orders)"
_STYLE_CODES = ", ".join(["CASE WHEN length(t) < 40 THEN 'too_short' END", "CASE " + " ".join(rf"WHEN regexp_matches(t, '{p}', 'im') THEN 'banned_opener_{i}'" for i, p in enumerate(T.OPENERS)) + " END", *[rf"CASE WHEN regexp_matches(t, '{p}', 'i') THEN 'banned_phrase_{i}' END" for i, p in enumerate(T.PHRASES)], "CASE WHEN " + " AND ".join(rf"regexp_matches(t, '{p}', 'i')" for p in T.CLUSTER) + f" THEN '{T.CLUSTER_CODE}' END"])
_ANS = f"""(SELECT k, CASE WHEN k % 11 = 0 THEN 'none' WHEN k % 13 = 0 THEN 'leak' ELSE 'block' END AS kind, k % 15 AS m, k % 7 = 0 AS brief, q FROM (SELECT {_K} AS k, l_quantity::INT AS q FROM lineitem))"""
_WIN = lambda w: f"CASE WHEN len({w}) = 0 THEN [] ELSE list_distinct([array_to_string({w}[i:i + 2], ' ') for i in range(1, greatest(len({w}) - 1, 2))]) END"
SQL = {
    "caption_changes": rf"""WITH x AS (SELECT b.item_id, b.text AS t, coalesce(o.text || ' and so on', b.text) AS o FROM benchmark b LEFT JOIN benchmark o ON o.item_id = b.item_id + 1), w AS (SELECT item_id, regexp_extract_all(lower(t || ' ' || o), '[^ \t\n\x0b\f\r]+') AS a, regexp_extract_all(lower(o), '[^ \t\n\x0b\f\r]+') AS b FROM x),
      s AS (SELECT item_id, {_WIN('a')} AS a, {_WIN('b')} AS b FROM w), n AS (SELECT *, len(list_intersect(a, b)) AS c FROM s) SELECT item_id, round_even(1 - coalesce(c / nullif(len(a) + len(b) - c, 0), 1), 6) AS responsiveness FROM n""",
    "sidecar_drops": """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders), r AS (
        SELECT k, 'caption' AS task, 0 AS n FROM o WHERE k % 5 != 0 UNION ALL SELECT k, 'cross_view', 0 FROM o WHERE k % 5 != 0 AND k % 3 = 0
        UNION ALL SELECT k, 'grounding', length('Locate the regions.' || chr(10) || '[{"label":"water","bbox":[0.25,0.5,' || (k % 4 / 4 + 0.25)::DOUBLE || ',1.0]},{"label":"trees","bbox":[0.25,0.5,0.75,1.0]}]') FROM o WHERE k % 2 = 0)
      SELECT task, CASE WHEN k % 7 = 0 THEN 'leaked_base' WHEN n > 126 THEN 'prompt_too_long' WHEN task = 'grounding' AND k % 4 = 0 THEN 'grounding:item_0_bbox_range' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "coordinate_literals": rf"SELECT doc_id FROM {_D} WHERE regexp_matches(text, '-?\d{{1,3}}\.\d{{4,}}\s*,\s*-?\d{{1,3}}\.\d{{4,}}')",
    "banned_words": f"SELECT * FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'password' WHEN contains(lower(text), 'secret') THEN 'secret' WHEN contains(lower(text), 'the') THEN 'The' END AS hit FROM {_D}) WHERE hit IS NOT NULL",
    "caption_violations": rf"SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 400 THEN 'length_cap' END, CASE WHEN regexp_matches(text, '-?\d{{1,3}}\.\d{{4,}}\s*,\s*-?\d{{1,3}}\.\d{{4,}}') THEN 'coordinate_literal' END, CASE WHEN contains(lower(text), 'license') THEN 'banned_substring' END) AS codes FROM {_D}",
    "style_violations": f"WITH x AS (SELECT doc_id, concat_ws(',', {_STYLE_CODES}) AS codes FROM (SELECT doc_id, trim(text, ' ') AS t FROM {_D})) SELECT *, contains(codes, 'banned_opener_') OR contains(codes, 'too_short') OR (length(codes) - length(replace(codes, 'banned_phrase_', ''))) // 14 >= 2 OR (contains(codes, '{T.CLUSTER_CODE}') AND contains(codes, 'banned_phrase_')) AS retry FROM x",
    "coarse_percentages": f"SELECT k, replace(replace(text, 'covers ' || printf('%.1f', p) || '%', 'covers ' || {_Q('printf(' + chr(39) + '%.1f' + chr(39) + ', p)::DOUBLE')}), 'trees ' || q || '%', 'trees ' || {_Q('q')}) AS text, 2 AS n FROM {_N}",
    "redacted_places": f"SELECT k, {_RED('text')} AS text, 1 + (k % 3 = 0)::INT + (k % 4 = 0)::INT AS n FROM {_N}",
    "readable_texts": "SELECT k, replace(replace(replace(replace(text, '**Built**', 'Built'), '`crops`', 'cropland'), 'and trees', 'and tree cover'), 'zz', 'zz') AS text FROM " + _N,
    "capped_texts": f"SELECT doc_id, CASE WHEN length(trim(text, ' ')) <= 60 THEN trim(text, ' ') ELSE rtrim(substr(trim(text, ' '), 1, 59), ' ') || '…' END AS text FROM {_D}",
    "word_counts": rf"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS words FROM {_D}",
    "safe_names": "SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'row' ELSE substr(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 200) END AS name FROM pages",
    "template_fill": "WITH x AS (SELECT n_nationkey::BIGINT AS id, 'Country ' || n_name || ' (' || n_nationkey || ') has a long story to tell.' AS s FROM nation) SELECT id, CASE WHEN length(s) <= 40 THEN s ELSE rtrim(substr(s, 1, 39), ' ') || '…' END AS text FROM x",
    "etags": f"SELECT doc_id, 'W/\"' || substr(sha256(text), 1, 24) || '\"' AS etag FROM {_D}",
    "media_paths": f"SELECT {_K} AS k, CASE l_linenumber % 4 WHEN 0 THEN 'images/tag/' || l_orderkey WHEN 1 THEN 'stills/tag/' || l_orderkey WHEN 2 THEN 'other/' || l_orderkey ELSE 'images/tag/' || l_orderkey END AS path FROM lineitem",
    "fallback_paths": "SELECT c_custkey, pos, CASE WHEN c_custkey % 2 != 0 THEN 'images/' || c_custkey WHEN pos = 0 THEN 'org__set/images/' || c_custkey WHEN pos = 1 THEN 'org/set/images/' || c_custkey ELSE 'images/' || c_custkey END AS path FROM customer, (SELECT unnest(range(3)) AS pos) WHERE c_custkey % 2 = 0 OR pos = 0",
    "term_matches": rf"SELECT doc_id, concat_ws(',', {', '.join(rf'''CASE WHEN regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9]{p}[^a-z0-9]') THEN '{n}' END''' for n, p in (('the', 'the'), ('open source', r'open\s+source'), ('license', 'license'), ('sea', 'sea')))}) AS terms FROM {_D}",
    "chat_lengths": f"WITH x AS (SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_chars, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_chars FROM {_C} GROUP BY conv_id) SELECT *, CASE WHEN user_chars > 300 THEN 'dropped_user_too_long' WHEN user_chars + assistant_chars > 600 THEN 'dropped_total_too_long' ELSE 'kept' END AS why FROM x",
    "turn_lengths": f"SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_chars, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_chars FROM {_C} GROUP BY conv_id",
    "canonical_rows": f"SELECT CASE WHEN k % 4 != 0 THEN k::VARCHAR ELSE 'e' || k END AS sample_id, CASE WHEN k % 5 = 0 THEN 'sft' ELSE o_orderstatus END AS task, 'wildfire' AS profile, 'train' AS split, concat_ws('|', a, b) AS paths, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS n FROM {_IM}",
    "row_gate": f"WITH x AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS b FROM {_C} GROUP BY conv_id) SELECT conv_id, CASE {' '.join(f'''WHEN contains(lower(b), '{x}') THEN 'bloat:{x}' ''' for x in T.BLOAT)} WHEN length(b) > 900 THEN 'prompt_too_long' ELSE 'kept' END AS why FROM x",
    "media_complete": f"""WITH x AS (SELECT k, unnest([a, b]) AS p FROM {_IM}), f AS (SELECT DISTINCT p FROM x WHERE k % 7 != 0) SELECT k FROM x LEFT JOIN f USING (p) WHERE x.p IS NOT NULL GROUP BY k HAVING count(f.p) = count(*)""",
    "path_remap": f"""WITH x AS (SELECT k, unnest([a, b]) AS p, unnest([1, 2]) AS i FROM {_IM}), m AS (SELECT DISTINCT p AS old, 'moved/' || p AS new FROM x WHERE k % 2 = 0 AND p IS NOT NULL)
      SELECT k, string_agg(coalesce(new, p), '|' ORDER BY i) AS paths FROM x LEFT JOIN m ON x.p = m.old WHERE p IS NOT NULL GROUP BY k""",
    "class_claims": rf"""SELECT doc_id, concat_ws(',', {_CLAIM}) AS claims, {' OR '.join(f"contains(l, '{h}')" for h in S.HEDGES)} AS hedged, concat_ws(',', CASE WHEN regexp_matches(l, '\[captions?\s*:') THEN 'captions_marker' END, CASE WHEN contains(l, '[boxes]') THEN 'boxes_marker' END) AS leaks FROM (SELECT doc_id, lower(text) AS l FROM {_D})""",
    "contract_scores": rf"""WITH c AS (SELECT {_K} AS k, CASE WHEN ({_K}) % 7 = 0 THEN 'Short text.' ELSE 'The water covers about ' || l_quantity::INT || '% of a scene with trees, roads and an uncertain glacier far behind the town.' END AS prose, [{', '.join("'" + b + "'" for b in _BLOCKS)}][({_K}) % {len(_BLOCKS)} + 1] AS body FROM lineitem),
      t AS (SELECT k, CASE WHEN k % 11 = 0 THEN prose WHEN k % 13 = 0 THEN '[boxes] ' || prose ELSE prose || chr(10) || '```json' || chr(10) || body || chr(10) || '```' END AS c FROM c),
      f AS (SELECT k, c, trim(regexp_extract_all(c, '```(?:json)?\s*\n?([\s\S]*?)```', 1, 'i')[-1], chr(10) || ' ') AS b, len(regexp_extract_all(regexp_replace(c, '(?i)```(?:json)?\s*\n?([\s\S]*?)```', ''), '[^ \t\n\x0b\f\r]+')) AS words FROM t),
      v AS (SELECT *, CASE WHEN starts_with(b, '{{') AND json_valid(b) THEN b END AS j FROM f),
      i AS (SELECT k, u.i - 1 AS i, u.x AS x FROM (SELECT k, unnest(list_zip(range(1, len(json_extract(j, '$.boxes[*]')) + 1), json_extract(j, '$.boxes[*]')))  AS z FROM v WHERE j IS NOT NULL), LATERAL (SELECT z[1] AS i, z[2] AS x) u),
      n AS (SELECT *, [TRY_CAST(json_extract_string(x, '$.bbox[' || q || ']') AS DOUBLE) for q in range(4)] AS p FROM i),
      e AS (SELECT k, arg_min(code, i) AS code FROM (SELECT k, i, 'box_' || i || CASE WHEN json_type(x) != 'OBJECT' THEN '_not_object' WHEN coalesce(json_type(x, '$.bbox'), '') != 'ARRAY' OR json_array_length(x, '$.bbox') != 4 THEN '_bbox_shape' WHEN list_bool_or([y IS NULL for y in p]) THEN '_bbox_numeric' WHEN NOT list_bool_and([y BETWEEN 0 AND 1 for y in p]) THEN '_bbox_range' WHEN NOT (p[1] < p[3] AND p[2] < p[4]) THEN '_bbox_order'
          WHEN coalesce(json_type(x, '$.confidence'), 'NULL') IN ('VARCHAR', 'ARRAY', 'OBJECT') THEN '_confidence_type' WHEN NOT coalesce(json_extract_string(x, '$.confidence')::DOUBLE BETWEEN 0 AND 1, true) THEN '_confidence_range' END AS code FROM n) WHERE code IS NOT NULL GROUP BY k),
      w AS (SELECT v.k, words, c, b, j, CASE WHEN j IS NULL THEN NULL WHEN coalesce(json_type(j, '$.boxes'), 'NULL') = 'NULL' THEN 'missing_boxes_key' WHEN json_type(j, '$.boxes') != 'ARRAY' THEN 'boxes_not_list' ELSE code END AS error FROM v LEFT JOIN e ON v.k = e.k),
      g AS (SELECT *, CASE WHEN regexp_matches(c, '\[captions?\s*:|\[boxes\]', 'i') THEN 'leak' WHEN b IS NULL THEN 'no_fenced_block' WHEN j IS NULL THEN 'json_parse_failed' WHEN error IS NOT NULL THEN 'schema_invalid' WHEN words < 12 THEN 'preamble_too_short' ELSE 'ok' END AS verdict FROM w)
      SELECT k, CASE verdict WHEN 'json_parse_failed' THEN 0.4 WHEN 'schema_invalid' THEN 0.6 WHEN 'preamble_too_short' THEN 0.8 WHEN 'ok' THEN 1.0 ELSE 0.0 END::DOUBLE AS score, verdict, error FROM g""",
    "document_faithfulness": rf"""WITH x AS (SELECT doc_id, text, lower(text) AS l, list_filter([{_CLAIM.replace("contains(l,", "contains(lower(text),")}], lambda z: z IS NOT NULL) AS claims, [v::DOUBLE for v in regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*(?:%|percent)', 1, 'i')] AS said FROM {_D}),
      y AS (SELECT *, len(list_filter(claims, lambda z: z IN ('water', 'trees'))) AS known, len(list_filter(claims, lambda z: z NOT IN ('water', 'trees'))) AS invented, len(list_filter(said, lambda v: least(abs(v - 30), abs(v - 10)) > 15)) AS misses, {' OR '.join(f"contains(l, '{h}')" for h in S.HEDGES)} AS hedged,
        doc_id % 3 = 1 AND doc_id % 2 = 1 AND (contains(l, 'no ship') OR contains(l, 'no vessels') OR contains(l, 'no maritime')) AND NOT (contains(l, 'tim') OR contains(l, 'model') OR contains(l, 'candidate')) AS denies,
        regexp_matches(text, '\[captions?\s*:|\[boxes\]|\bx1\s*=\s*0\.0|tim[-\s]style\s+analytics\s+json\s*:?', 'i') AS leak FROM x),
      z AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN hedged THEN 0.15::DOUBLE ELSE -0.30::DOUBLE END ELSE CASE WHEN known = 2 THEN 0.28::DOUBLE WHEN known = 1 THEN 0.18::DOUBLE ELSE -0.15::DOUBLE END - least(2, invented) * 0.1::DOUBLE END + 0.5::DOUBLE - least(0.20::DOUBLE, misses * 0.10::DOUBLE) - CASE WHEN denies THEN 0.20::DOUBLE ELSE 0 END AS s FROM y)
      SELECT doc_id, CASE WHEN trim(l, ' ') = '' THEN 0.0::DOUBLE ELSE round_even(greatest(0, least(1, CASE WHEN leak THEN least(s, 0.40::DOUBLE) ELSE s END)), 4) END AS score FROM z""",
    "label_names": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'water' WHEN 1 THEN 'vegetation' WHEN 2 THEN 'bare' WHEN 3 THEN 'snow_ice' WHEN 4 THEN 'built' END AS label FROM part",
    "grounding_errors": """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'oops' ELSE '[{"label": "a", "bbox": [0.1, 0.2, 0.3, 0.4]}, {"label": "' || CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'b' END || '", "bbox": [0.1, 0.2, ' || ['1.7', '0.05', '0.9'][c_custkey % 3 + 1] || ', 0.9]}]' END AS t FROM customer),
      i AS (SELECT c_custkey, unnest(range(json_array_length(t)::BIGINT)) AS i, t FROM t WHERE json_valid(t)), b AS (SELECT c_custkey, i, json_extract_string(t, '$[' || i || '].label') AS label, list_transform(range(0, 4), lambda k: json_extract_string(t, '$[' || i || '].bbox[' || k || ']')::DOUBLE) AS v FROM i),
      e AS (SELECT c_custkey, i, CASE WHEN trim(label) = '' THEN 'empty_label' WHEN list_min(v) < 0 OR list_max(v) > 1 OR v[3] <= v[1] OR v[4] <= v[2] THEN 'bbox_range' END AS e FROM b)
      SELECT t.c_custkey, CASE WHEN NOT json_valid(t) THEN 'json_decode' ELSE coalesce(arg_min('item_' || i || '_' || e, i) FILTER (e IS NOT NULL), 'ok') END AS error FROM t LEFT JOIN e USING (c_custkey) GROUP BY t.c_custkey, t""",
    "focus_sentences": f"SELECT c_custkey, 'In this satellite imagery, **' || {'[' + ', '.join(chr(39) + x + chr(39) for x in P.raster.LAND_COVER) + ']'}[c_custkey % 9 + 1] || '** accounts for about ' || round_even((c_custkey % 8) / 8.0::DOUBLE * 100, 1) || '% of valid pixels, showing ' || CASE WHEN c_custkey % 7 = 0 THEN 'spatially mixed appearance in this resolution.' WHEN c_custkey % 7 <= 2 THEN 'one or two dominant contiguous patches.' WHEN c_custkey % 7 <= 5 THEN 'several separated patches.' ELSE 'many small fragments across the tile.' END AS text FROM customer",
    "small_object_scores": "WITH x AS (SELECT c_custkey, c_custkey % 6 + 1 AS n, [(c_custkey % 10 + i) / 100.0::DOUBLE for i in range(1, c_custkey % 6 + 2)] AS a FROM customer) SELECT c_custkey, round(list_avg([greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (y - 0.02::DOUBLE) / 0.06::DOUBLE)) for y in a]) * greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest(0, n - 3) * 0.12::DOUBLE), 6) AS score FROM x",
    "hash_labels": "WITH u AS (SELECT ('0x' || substr(sha256('label|' || c_custkey), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM customer) SELECT CASE WHEN u < 0.25 THEN 0 WHEN u < 0.75 THEN 1 ELSE 7 END::BIGINT AS class_id, count(*) AS n FROM u GROUP BY 1",
    "flag_counts": f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(concat_ws(',', {_STYLE_CODES}), ',')) AS flag FROM (SELECT trim(text, ' ') AS t FROM {_D})) WHERE flag != '' GROUP BY flag",
    "last_exchanges": f"SELECT conv_id, arg_min(text, (turn, role, text)) FILTER (role = 'system') AS system, {_LAST('user')} AS user, {_LAST('assistant')} AS assistant FROM {_C} GROUP BY conv_id",
    "lexical_scores": rf"""WITH x AS (SELECT doc_id, ' ' || lower(text) || ' ' AS l, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS words FROM {_D}),
      y AS (SELECT doc_id, words, regexp_matches(l, '[^a-z0-9](the|der)[^a-z0-9]')::INT + regexp_matches(l, '[^a-z0-9](water|river)[^a-z0-9]')::INT + regexp_matches(l, '[^a-z0-9]and[^a-z0-9]')::INT AS g, regexp_matches(l, '[^a-z0-9]password[^a-z0-9]')::INT AS f, regexp_matches(l, '[^a-z0-9]license[^a-z0-9]')::INT AS r FROM x)
      SELECT doc_id, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, g / 3 * 0.75::DOUBLE + least(1.0::DOUBLE, words / 20.0::DOUBLE) * 0.15::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - r * 0.25::DOUBLE) * 0.10::DOUBLE - f * 0.25::DOUBLE)), 6) AS score, g::BIGINT AS groups_hit, f::BIGINT AS forbidden, r::BIGINT AS risky, words FROM y""",
    "faithfulness_scores": f"""WITH x AS (SELECT *, kind = 'block' AND m = 12 AS sea, kind = 'block' AND m BETWEEN 10 AND 12 AS sure FROM {_ANS}), y AS (SELECT k, 0.5::DOUBLE + CASE WHEN k % 4 = 0 THEN CASE WHEN brief AND NOT sure THEN -0.30::DOUBLE ELSE 0.15::DOUBLE END WHEN NOT brief THEN 0.08::DOUBLE WHEN sea THEN 0.18::DOUBLE ELSE -0.15::DOUBLE END - CASE WHEN NOT brief AND q > 45 THEN 0.1::DOUBLE ELSE 0 END AS s, kind = 'leak' AS leak FROM x)
      SELECT k, CASE WHEN k % 6 != 0 THEN round_even(greatest(0, least(1, CASE WHEN leak THEN least(s, 0.40::DOUBLE) ELSE s END)), 4) END AS score FROM y""",
    "composite_scores": f"""WITH w AS (SELECT *, CASE WHEN lexical IS NOT NULL THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN grounding IS NOT NULL THEN 0.42::DOUBLE ELSE 0 END + 0.22::DOUBLE + CASE WHEN composite IS NOT NULL THEN 0.18::DOUBLE ELSE 0 END AS total FROM ({t.RESULTS_SQL})),
      v AS (SELECT *, greatest(0, least(1, (coalesce(lexical * 0.18::DOUBLE, 0) + coalesce(grounding * 0.42::DOUBLE, 0) + pass_value / 2 * 0.22::DOUBLE + coalesce(composite * 0.18::DOUBLE, 0)) / total * greatest(0, 1.0::DOUBLE - part % 3 * 0.25::DOUBLE - 0.08::DOUBLE))) AS a FROM w),
      c AS (SELECT *, CASE WHEN grounding IS NOT NULL AND part % 4 = 0 THEN least(a, 0.42::DOUBLE) ELSE a END AS b FROM v) SELECT model, count(*) AS n, round(avg(round_even(CASE WHEN part % 17 = 0 THEN least(b, 0.35::DOUBLE) ELSE b END, 4)), 3) AS mean FROM c GROUP BY model""",
}
