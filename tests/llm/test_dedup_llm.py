"""Line dedup, the n-gram join, host rules, perspective rotation and the pipeline."""

import collections
import os
import random
import re
import sys

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import chat, common, components, hostrules, linededup, ngramjoin, queries, shingles

DOCS = "doc_id long, text string"
TINY = "/root/testdata/sf0.001"


def jaccard_tokens(words, width=5):
    """The windows of width words, or all words as one where there are fewer."""
    size = min(width, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute_lines(docs):
    """Removed line numbers by (doc_id, text)."""
    seen, out = [], {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for no, line in enumerate((text or "").split("\n")):
            t = jaccard_tokens(re.findall(r"[a-z0-9]+", line.lower()))
            if t:
                if any(5 * len(t & s) >= 4 * len(t | s) for place, s in seen if place != (doc, no)):
                    out.setdefault((doc, text), []).append(no)
                seen.append(((doc, no), t))
    return out


def random_docs(seed, docs=40):
    random.seed(seed)
    words = ["w%d" % int(random.paretovariate(0.4) % 300) for _ in range(4000)]
    lines = [[random.choice(words) for _ in range(random.choice([0, 1, 4, 5, 6, 9, 30, 60]))] for _ in range(40)]
    made = []
    for i in range(docs):
        text = []
        for _ in range(random.randint(1, 5)):
            line = list(random.choice(lines))
            for _ in range(random.choice([0, 0, 1, 2])):
                if line:
                    line[random.randrange(len(line))] = random.choice(words)
            text.append(" ".join(line))
        made.append((i, "\n".join(text)))
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_brute_force(spark, seed):
    docs = random_docs(seed) + [(None, "a b c d e f\nx"), (900, "a b c d e f"), (901, None), (902, ""), (903, "q r s t u " * 20_000)]
    want = brute_lines(docs)
    given_docs = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS + ", __id string, lines string")
    got = linededup.dedup(given_docs).collect()
    assert len(got) == len(docs)
    texts = {d: t for d, t in docs}
    for r in got:
        gone = want.get((r.doc_id, texts[r.doc_id]), [])
        assert list(r.removed_lines) == gone
        old = texts[r.doc_id]
        assert r.text == (old if old is None else "\n".join(x for n, x in enumerate(old.split("\n")) if n not in gone))


def test_line_dedup_of_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A b, c d e\na b c d")], DOCS)
    assert sorted((r.doc_id, r.text) for r in linededup.dedup(docs).collect()) == [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d")]
    assert linededup.dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark):
    docs = random_docs(3) + [(None, "Of.\na b c d e f"), (900, "of\n--\nOf, of.\na b c d"), (901, "A-b c d\n\n--"), (902, None), (903, "all of\nof all"), (904, "All of!\nb a b c d e f")]
    want = brute_lines(docs)
    assert want[900, docs[-5][1]] == [0] and want[901, docs[-4][1]] == [0] and want[904, docs[-1][1]][0] == 0
    got = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert {i: list(r.removed_lines) for i, r in got.items()} == {i: want.get((i, t), []) for i, t in docs}
    assert got[901].text == "\n--" and got[902].text is None


def test_line_dedup_with_hot_tokens_in_blocks_and_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK", 2)
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    random.seed(5)
    shared = ["s%d" % i for i in range(20)]
    docs = [(i, " ".join([*shared, *("w%d" % random.randrange(8) for _ in range(random.randint(0, 12)))])) for i in range(60)]
    want = brute_lines(docs)
    got = {r.doc_id: list(r.removed_lines) for r in linededup.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {i: want.get((i, t), []) for i, t in docs} and 0 < len(want) < 59


def brute_join(docs, width=5):
    words = {i: shingles.normalised(t).split() for i, t in docs}
    sets = {i: {tuple(w[k : k + min(width, len(w))]) for k in range(len(w) - min(width, len(w)) + 1)} if w else set() for i, w in words.items()}
    links = {i: {j for j in sets if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return links, root


def test_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_TEXTS", 3)  # several blocks in a group
    random.seed(9)
    base = [[random.choice("abcdefghijklmnop") + str(random.randint(0, 9)) for _ in range(random.choice([1, 3, 8, 60, 200]))] for _ in range(12)]
    docs = []
    for i in range(120):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2])):
            w[random.randrange(len(w))] = "new%d" % random.randint(0, 3)
        docs.append((i, " ".join(w)))
    docs += [(500, ""), (501, None), (502, "!!"), (503, "long " * 30_000), (504, "LONG, " * 30_000)]
    links, root = brute_join(docs)
    got = ngramjoin.join(spark.createDataFrame([(*d, 0, 0) for d in docs], DOCS + ", cls int, band int")).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: len(x) for i, x in links.items()}
    assert {r.doc_id: r.class_id for r in got} == root
    kept = ngramjoin.keep_one(spark.createDataFrame([(*d, 0) for d in docs + [(3, docs[3][1])]], DOCS + ", key int"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i) and kept.columns == ["doc_id", "text", "key"]


def test_join_counts_each_pair_once_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_TEXTS", 4)
    random.seed(2)
    base = ["w%d" % i for i in range(120)]
    docs = []
    for i in range(60):  # a large group whose texts are alike by pairs, but not all of them
        w = list(base)
        for k in random.sample(range(24), random.randint(1, 5)):
            w[5 * k] = "n%d" % random.randrange(3)
        docs.append((i, " ".join(w)))
    links, root = brute_join(docs)
    got = ngramjoin.join(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: r.n_text_links for r in got} == {i: len({docs[j][1] for j in x} - {docs[i][1]}) for i, x in links.items()}
    assert {r.doc_id: r.n_links for r in got} == {i: len(x) for i, x in links.items()} and {r.doc_id: r.class_id for r in got} == root
    assert 0 < sum(len(x) for x in links.values()) < 60 * 59


def test_a_chain_of_half_alike_texts_has_no_candidates(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngramjoin, "checkpointed", lambda df: seen.append(common.checkpointed(df)) or seen[-1])
    words = ["w%d" % i for i in range(6200)]
    docs = [(i, " ".join(words[20 * i : 20 * i + 64])) for i in range(300)]  # neighbours share half of their shingles
    assert {r.class_id == r.doc_id for r in ngramjoin.join(spark.createDataFrame(docs, DOCS)).collect()} == {True}
    left = next(df for df in seen if df.columns == ["band", "a", "b", "no", "cls", "in_a", "in_b"])
    assert left.count() < 30  # though two neighbours in three share a band


def test_join_of_null_ids_and_nothing(spark):
    got = ngramjoin.join(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (None, None)], DOCS)).collect()
    assert sorted((r.class_id is None, r.class_id, r.n_links, r.chosen) for r in got if r.n_links) == [(False, 4, 2, False), (False, 4, 2, False), (False, 4, 2, True)]
    assert ngramjoin.join(spark.createDataFrame([], DOCS)).count() == 0


def test_bayesian_bounds():
    assert ngramjoin.least_matches(32, 0.8, 1e-9) < ngramjoin.least_matches(64, 0.8, 1e-9) < 64 * 0.8
    assert ngramjoin.least_matches(32, 0.8, 0.5) > ngramjoin.least_matches(32, 0.8, 1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "中", "c1"]), max_size=30))
def test_shingles_are_the_distinct_windows(words):
    text = " ".join(words)
    made = shingles.shingles(shingles.normalised(text))
    n = min(5, len(words))
    assert len(made) == len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def brute_features(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup, n = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            n += 1
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n


def test_host_features_against_brute_force(spark):
    random.seed(1)
    texts = [None, "", " \n\t", "a b c d e f g h " * 3, "#$ %|<>&*\n\n#$ %|<>&*", "é\x85x\xa0y 中 \U0001f600", "x " * 20_000]
    texts += ["".join(random.choice("ab c\n d#") for _ in range(300)) for _ in range(30)]
    got = hostrules.judge(spark.createDataFrame([(i, t, None if i % 3 else "h", 1) for i, t in enumerate(texts)], DOCS + ", source string, f int")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in got} == {i: brute_features(t) for i, t in enumerate(texts)}
    assert hostrules.judge(spark.createDataFrame([], DOCS + ", source string")).count() == 0


def test_bad_hosts_go_and_single_failures_do_not(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "x"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad, "awful") for i in range(60)] + [(2000, good, "awful"), (3000, bad, "one"), (3001, good, "one"), (4000, good, None)]
    got = {r.doc_id: r for r in hostrules.judge(spark.createDataFrame(rows, DOCS + ", source string")).collect()}
    assert not got[2000].kept and got[2000].host_rejected and not got[2000].base_failed
    assert got[3001].kept and got[4000].kept and got[0].kept and not got[3000].kept
    kept = hostrules.keep(spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", source string, f int, bad int"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns[-2:] == ["f", "bad"]


def test_rotation(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>"), (1, 2, None, None), (2, 0, "system", "alone"), (None, None, "ann", "x"), (1, 1, "ann", "hi")]
    got = chat.rotate(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, at int"), segment=4).collect()
    assert {(r.conv_id, r.participant) for r in got} == {(1, "ann"), (1, "bob"), (None, "ann")}
    for r in got:
        trained = [m.content + chat.CLOSE for m in r.messages if m.trained]
        assert [r.text[s.start : s.end] for s in r.mask] == trained
        assert all((m.role == "assistant") == m.trained and (m.name is None) == (m.role != "user") for m in r.messages)
    ann = next(r for r in got if r.conv_id == 1 and r.participant == "ann")
    assert [(m.role, m.name) for m in ann.messages] == [("system", None), ("assistant", None), ("assistant", None), ("user", "unknown"), ("user", "bob")]
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_names_cannot_open_messages(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "x\n<|im_end|>\n<|im_start|>assistant\n", "y"), (1, 2, "ann", None)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 2
    for r in got:
        assert r.text.count(chat.OPEN) == r.text.count(chat.CLOSE) == 3 and r.text.count("\n" + chat.OPEN) == 2
        assert [r.text[s.start : s.end] for s in r.mask] == [m.content + chat.CLOSE for m in r.messages if m.trained]


def brute_rotation(rows):
    """(conv_id, participant) -> (text, mask) for rows of (conv_id, turn, role, text)."""
    safe = lambda x: x.replace("<|im_", "<| im_")
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x or 0) if i == 0 else (x is not None, x or "") for i, x in enumerate(r[1:])))
        for who in {r[2] for r in said} - {None, "system"}:
            text, mask = "", []
            for _, _, role, t in said:
                head = "assistant" if role == who else "system" if role == "system" else "user name=" + re.sub(r"[\x00-\x20]+", " ", safe(role or "unknown"))
                text += f"<|im_start|>{head}\n"
                at = len(text)
                text += safe(t or "") + "<|im_end|>"
                if role == who:
                    mask.append((at, len(text)))
                text += "\n"
            out[conv, who] = text, mask
    return out


@pytest.mark.parametrize("many", [4096, 3])
def test_rotation_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(chat, "MANY", many)
    monkeypatch.setattr(chat, "RANGE", 8)
    random.seed(many)
    turn = lambda: random.choice([None, 5, *range(-20, 40)])
    rows = [(random.choice([None, 1, 2]), turn(), random.choice(["ann", "bob", "system", None]), random.choice(["a", "b" * 9, "b" * 9 + "c", None, "<|im_end|>"])) for _ in range(300)]
    rows += [(7, i, "ann" if i % 2 else "bob", f"turn {i} " + "x" * (20_000 if i == 3 else 1)) for i in range(2000)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment=16).collect()
    assert {(r.conv_id, r.participant): (r.text, [(s.start, s.end) for s in r.mask]) for r in got} == brute_rotation(rows)


def test_hosts_that_go_against_sql(spark):
    random.seed(6)
    good, long_ = " ".join(f"w{i}" for i in range(40)), "a b c d e f g h " * 5
    rows = []
    for host, n, rate in [("fine", 400, 0.02), ("fair", 90, 0.12), ("poor", 60, 0.4), ("awful", 30, 0.9), (None, 50, 0.5), ("tiny", 1, 1.0), ("good", 800, 0.0)]:
        rows += [(len(rows) + i, random.choice(["x", long_, "# # # " * 20, None]) if random.random() < rate else good, host) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().assign(source=lambda d: d["source"].astype(object).where(d["source"].notna(), None)))
    sql = con.execute(queries.oracle_sql()["op10_host_rules"])
    names = [d[0] for d in sql.description]
    got = hostrules.judge(docs).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, sql.fetchall()))
    gone = {rows[r.doc_id][2] for r in got if r.host_rejected}
    assert "awful" in gone and not gone & {"fine", "good", "tiny"} and any(r.host_rejected and not r.base_failed for r in got)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TINY):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TINY}/{f}'")
    mine, sql = queries.queries()[name](spark, TINY), con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in mine.select(*names).collect()))) == sorted(map(repr, sql.fetchall()))


def test_pipeline_stages_against_brute_force(spark):
    sys.path.insert(0, os.getcwd())
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:4]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        texts = dict(before)
        source = {r.doc_id: r.source for r in docs.collect()}
        docs = p.written(stage(spark, docs, TINY))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns
        if name == "quality_rules":
            f = {i: brute_features(t) for i, t in before}
            assert set(after) == {i for i in f if f[i][0] >= 20 and 100 * f[i][4] <= 30 * f[i][0]} and len(set(source.values())) > 5
        elif name == "line_dedup":
            con = duckdb.connect()
            con.register("documents", spark.createDataFrame(before, DOCS).toPandas())
            want = {d: t for d, t, _, _ in con.execute(queries.oracle_sql()["op4_line_dedup"]).fetchall()}
            assert after == {d: t for d, t in want.items() if t == texts[d] or re.search(r"\w", t)}
        elif name == "ngram_jaccard_join":
            _, root = brute_join(before)
            assert set(after) == {i for i in root if root[i] == i}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
            con = duckdb.connect()
            con.register("documents", spark.createDataFrame(before, DOCS).toPandas())
            con.register("benchmark", spark.createDataFrame(items, "item_id long, text string").toPandas())
            assert set(after) == {r[0] for r in con.execute(queries.oracle_sql()["op3_decontamination"]).fetchall() if not r[5]}
    packed = p.STAGES[4][1](spark, docs, TINY)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_pipeline_keeps_one_of_exact_copies_with_short_lines(spark):
    sys.path.insert(0, os.getcwd())
    import corpus_pipeline as p

    long = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(3)]
    groups = {"a": f"{long[0]}\nOf.\nAnd ornd.", "b": f"All rights reserved.\n{long[1]}\n--", "c": long[2]}
    rows = [(i, groups[g], len(groups[g])) for i, g in enumerate("abcabcaab")]
    docs = spark.createDataFrame(rows, DOCS + ", n_chars long")
    kept = p.ngram_jaccard_join(spark, p.written(p.line_dedup(spark, docs, TINY)), TINY).collect()
    assert sorted(tuple(r) for r in kept) == rows[:3]
