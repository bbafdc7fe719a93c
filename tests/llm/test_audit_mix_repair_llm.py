"""The filter audit, the mix of sources and conversation repair against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import chatrepair, filteraudit, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# Filter audit


def brute_audit(docs, labels):
    """Rows by (part, order, step), by applying the filters to documents one after another."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(doc, text):
        w, t = words(text), text or ""
        out = set()
        if len(w) < 100:
            out.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            out.add("C")
        if set(t) & set("#$%&*|"):
            out.add("D")
        if doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in docs):
            out.add("E")
        return out

    found = [(d, part or "", fails(d, t)) for d, t, part in docs]
    out = {}
    for part in {p for _, p, _ in found}:
        own = [(d, f) for d, p, f in found if p == part]
        removed_by = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                removed_by[f] += len(gone)
                failing = sum(f in x[1] for x in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def audit_docs():
    random.seed(4)
    texts = [None, "", " \x0b", "A $", "Aé bc " * 60, "x " * 300, *(" ".join(random.choice(["w%d", "W%d", "%d|"]) % random.randrange(400) for _ in range(n)) for n in (20, 99, 100, 101, 400, 2000))]
    docs = [(i, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(7, docs[3][1], "fr"), (7, docs[3][1], "fr"), (None, docs[0][1], "en"), (None, "only here", None), (200, "only here", "en"), (3, "y " * 50_000, "de")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_against_brute_force(spark):
    docs, labels = audit_docs()
    table = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, lang string, n int, mask string, digest string")
    got = filteraudit.audit(table.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 600 * len({p or "" for _, _, p in docs})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_audit_of_nothing_and_of_other_filters(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filteraudit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 1, 2, 0, 2)], "part string, mask int, n long, n_good long, n_toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filteraudit.interactions(cells, "XY").collect()}
    assert got == {("XY", 1): (0, 7, 0, 2, 9), ("XY", 2): (0, 0, 5, 0, 5), ("YX", 1): (2, 5, 0, 0, 5), ("YX", 2): (0, 2, 5, 2, 9)}
    with pytest.raises(ValueError):
        filteraudit.interactions(cells, "AA")


# The mix of sources


def brute_targets(sizes, share=1.5, passes=2):
    """By repeated sharing, as the rule says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = {}, share * sum(sizes.values())
    while True:
        left = total - sum(full.values())
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if weight[s] * level > passes * sizes[s]]
        if not above:
            return full | {s: weight[s] * level for s in open_}
        full |= {s: passes * sizes[s] for s in above}


def mix_docs(seed):
    random.seed(seed)
    docs = [(i, None if i % 17 == 0 else "w " * int(random.paretovariate(0.8)), random.choices([None, "", "a", "B", "é", "z", "hot"], [1, 1, 3, 2, 1, 1, 9])[0]) for i in range(300)]
    return docs + [(905, "a b", "z"), (905, "a b", "z"), (None, "q " * 40, "z"), (None, None, "nothing"), (901, "", "nothing"), (902, "long " * 30_000, "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_against_brute_force(spark, seed, monkeypatch):
    docs = mix_docs(seed)
    table = spark.createDataFrame([(*d, "k", 3, 4) for d in docs], "doc_id long, text string, source string, key string, size int, turn int").repartition(3)
    rows = mixing.taken(table).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == collections.Counter((d, len(words(t))) for d, t, _ in docs)
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    goals = brute_targets(sizes)
    by_id = {d: s for d, _, s in docs}
    got = collections.Counter()
    for r in rows:
        s = by_id[r.doc_id] if r.doc_id is not None else ("z" if r["size"] else "nothing")
        assert r.source_size == sizes[s] and r.target == pytest.approx(goals[s]) and 0 <= r.taken <= 2 * r["size"]
        got[s] += r.taken
    assert sum(got.values()) == 3 * sum(sizes.values()) // 2
    assert all(abs(got[s] - goals[s]) <= len(goals) for s in goals)

    # The mix in order: no gaps, sources in step with each other, each of their copies once.
    mixed = mixing.mix(table).orderBy("position").collect()
    assert [r.position for r in mixed] == [0, *itertools.accumulate(r.words for r in mixed)][:-1]
    assert all(a.finish <= b.finish for a, b in itertools.pairwise(mixed))
    served = collections.Counter()
    for r in mixed:
        served[r.source] += r.words
        assert r.finish == pytest.approx(min(1.0, served[r.source] / goals[r.source]), abs=1e-6) or r.finish == 1.0
    # Neither the pieces nor how the input is cut change anything.
    monkeypatch.setattr(mixing, "SLOTS", 3)
    monkeypatch.setattr(mixing, "KEY_DIGITS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.taken(table.repartition(1)).collect())) == sorted(map(str, rows))


def test_mix_of_nothing_and_of_odd_shares(spark):
    docs = "doc_id long, text string, source string"
    assert mixing.taken(spark.createDataFrame([], docs)).count() == 0
    empty = mixing.taken(spark.createDataFrame([(1, None, None), (2, " ", "a")], docs)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in empty] == [(0, 0, 0.0, 0)] * 2
    two = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b", "y")], docs)
    assert {r.doc_id: r.taken for r in mixing.taken(two, weights=(1,), share=(1, 2), passes=1).collect()} == {1: 2, 2: 1}
    assert {r.doc_id: (r.target, r.taken) for r in mixing.taken(two, share=(2, 1)).collect()} == {1: (8.0, 8), 2: (4.0, 4)}
    with pytest.raises(ValueError):
        mixing.taken(two, share=(3, 1))


# Conversation repair


def least_edits(rows):
    """(cost, audit, lines) by trying every edit: rows are (role, text, fault)."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?")

    def walk(i, cost, audit, roles, lines):
        nonlocal best
        if best and (cost, audit) > best[:2] and cost > best[0]:
            return
        if i == len(rows):
            for tail in ("", "u", "a", "ua"):
                if grammar.fullmatch(roles + tail):
                    done = (cost + 2 * len(tail), audit + "I" * len(tail), lines + [{"u": "user:", "a": "assistant:"}[c] for c in tail])
                    if best is None or done[:2] < best[:2]:
                        best = done
            return
        role, text, fault = rows[i]
        walk(i + 1, cost + 3, audit + "D", roles, lines)
        if fault not in ("blank", "duplicate"):
            own = fault == "truncated"
            for new in ("", "u", "a"):
                grown, more = roles + new, lines + [{"u": "user:", "a": "assistant:"}[c] for c in new]
                head = audit + "I" * len(new)
                for letter, price, kept in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    initial = kept[:1]
                    if initial in ("s", "u", "a") and re.fullmatch(r"s?(ua)*u?", grown + initial):
                        walk(i + 1, cost + 2 * len(new) + price + own, head + letter, grown + initial, more + [f"{kept}:{text}"])

    walk(0, 0, "", "", [])
    return best


def brute_repair(turns):
    """The digest of every conversation, from (conv_id, turn, role, text) rows before the damage."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for c, turn, role, text in turns:
            if c == conv:
                role, text = (" " if x is None else x for x in (role, text))
                kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                if kind == 1:
                    text = ""
                if kind == 2:
                    text = re.sub("[.!?]", "", text)
                if kind == 4:
                    role = "user"
                rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faulty, seen = [], set()
        for _, role, text in rows:
            inner = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        there = [t for t, _, _ in rows if t is not None]
        cost, audit, lines = least_edits(faulty)
        counts = collections.Counter(f for _, _, f in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        gaps = min(max(there) - min(there) + 1 - len(set(there)), 2**63 - 1) if there else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repair_turns():
    random.seed(11)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ustr"], ["Hi.", "Well?", "no end", "Same.", " \t", "", None, "é! ", "x" * 5000 + ".", "line\nbreak!"]
    turns = []
    for c in range(60):
        for k in range(random.randint(1, 7)):
            text = random.choice(texts)
            turns.append((c, random.choice([None, -2, 3, k, k]) if c % 5 == 0 else k, random.choice(roles[: random.choice([2, 3, 9])]), text if text is None or k % 2 else f"{k} {text}"))
    return turns + [(None, 0, "user", "A."), (None, None, "assistant", "B"), (None, 9, "user", "A."), (77, 2**62, "user", "Far."), (77, -(2**62) - 5, "assistant", "Off.")]


@pytest.mark.parametrize("size", [1024, 2])
def test_repair_against_brute_force(spark, size):
    turns = repair_turns()
    table = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, at int, fault string").repartition(3)
    got = chatrepair.digest(chatrepair.damaged(table), size).collect()
    want = brute_repair(turns)
    assert len(got) == len(want)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua."), st.sampled_from("rcg")), max_size=7), st.integers(1, 4))
def test_segments_give_the_cheapest_and_least_edits(letters, size):
    names = {"s": "system", "u": "user", "a": "assistant", ".": "tool"}
    faults = {"r": "", "c": "truncated", "g": "blank"}
    cost, audit, _ = least_edits([(names[i], "t", faults[f]) for i, f in letters])
    parts = [letters[k : k + size] for k in range(0, len(letters), size)]
    strings = [("".join(i for i, _ in p), "".join(f for _, f in p)) for p in parts]
    ways, total = chatrepair.chained([chatrepair.segment_table(*s) for s in strings])
    edits = "".join(e for s, (p, q) in zip(strings, ways, strict=True) for e, _ in chatrepair.steps_of(*s, p, q))
    closing = {chatrepair.SYSTEM: "II", chatrepair.USER: "I"}.get(ways[-1][1] if ways else chatrepair.START, "")
    assert (total, edits + closing) == (cost, audit)


def test_repair_gives_turns_and_nothing_of_nothing(spark):
    turns = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (2, 0, "user", " ")], turns)
    got = [(r.conv_id, r.role, r.text, r.edit) for r in chatrepair.repair(rows).orderBy("conv_id", "at", "k").collect()]
    assert got == [(1, "user", "", "I"), (1, "assistant", "A.", "K"), (1, "user", "B.", "K"), (1, "assistant", "", "I")]
    none = spark.createDataFrame([], turns)
    assert chatrepair.repair(none).count() == 0 and chatrepair.digest(chatrepair.damaged(none)).count() == 0


def test_a_long_dialogue_is_solved_in_segments(spark):
    random.seed(3)
    turns = [(1, k, random.choice(["user", "assistant"]), f"m{k}{random.choice('.,')}") for k in range(5000)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    one, many = (chatrepair.digest(chatrepair.damaged(table), size).collect() for size in (8192, 64))
    assert one == many and len(one[0].audit) >= 4000
