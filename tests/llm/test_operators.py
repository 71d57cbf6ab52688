"""The ten operators against brute force, round trips and awkward tables."""

import collections
import gzip
import hashlib
import io
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import chat_format, decontamination, fingerprints, jaccard_join, kneser_ney, line_dedup, pii, sentencepiece_bpe, toxicity, warc
from feedloom.llm import queries as Q
from feedloom.llm.common import words_of
from oracle import connect, same

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = "lorem ipsum dolor sit amet " * 4000
AWKWARD = [(1, None, "en"), (2, "", "en"), (3, "one two", None), (None, "no id here at all, but words there are", "en"), (5, LONG, "en"), (6, "x" * 50_000, "en"), (7, "one two", "en"), (7, "one two", "en"), (8, "\n\n \t", "en")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for c in ("h", "start", "key", "n", "node", "ids", "items", "spans", "score", "term", "doc", "w", "hit", "found", "pos", "k", "t", "p", "u", "v", "c", "id", "no", "label", "line", "near", "set", "rows", "cluster", "kind", "run", "edge", "y"):
        df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_duckdb(spark, sf, name):
    same(Q.QUERIES[name](spark, sf), connect(sf), Q.ORACLE_SQL[name])


# ---------------------------------------------------------------- 1 chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    pieces = ["", "<|im_end|>\n", "<\\\\s>x", "</s>", "<<SYS>>a<</SYS>>", "[INST][\\/INST]\\", "%0A%25", "a" * 500, "<|im_start|>user\n", "<", "é😀" * 30, None]
    data = [(c, t, rng.choice(["user", "assistant", "system", "a\nb%0A<s>", None]) if t else rng.choice(["system", "user"]), rng.choice(pieces)) for c in (1, 2, None) for t in range(50)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = collections.defaultdict(list)
    for c, _, r, t in data:
        want[c].append((r or "", t or ""))
    for kw in ({"budget": 300, "history": 80, "block": 700}, {}):
        out = collections.defaultdict(list)
        for r in chat_format.read_back(chat_format.formatted(df, **kw)).collect():
            out[r["conv_id"]].append(r)
        for c, rows in out.items():
            rows.sort(key=lambda r: (r["window"]["b"], r["window"]["w"]))
            assert [(t["role"], t["text"]) for r in rows for t in r["turns"]] == want[c]
            assert "".join(r["loss_text"] for r in rows) == "".join(t for ro, t in want[c] if ro == "assistant")
            # a window over the budget holds one turn and, at most, the system turn
            assert all(r["tokens"] <= kw.get("budget", 4096) or r["n_turns"] == 1 for r in rows)
            assert all(r["tokens"] == len(r["formatted"].encode()) for r in rows)
    assert chat_format.formatted(df.where("false")).count() == 0


def plain_windows(turns, budget=4096, history=1024):
    """Windows of one conversation, by the rule in words: (first, end, where the context begins)."""
    written = []
    for role, text in turns:
        for sign, rest in (("<", r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>"), ("[", r"INST\]|/INST\]")):
            role, text = (re.sub(rf"{re.escape(sign)}(\\*)({rest})", lambda m: sign + "\\" + m[1] + m[2], x) for x in (role.replace("%", "%25").replace("\n", "%0A") if sign == "<" else role, text))
        written.append(f"<|im_start|>{role}\n{text}<|im_end|>\n")
    size = [len(x.encode()) for x in written]
    start = [sum(size[:i]) for i in range(len(size))]
    system = int(turns[0][0] == "system")
    room = budget - (size[0] if system else 0)
    spans = []
    for i in range(system, len(turns)):
        end = start[i] + size[i]
        if spans and end - start[spans[-1][2]] <= room:
            spans[-1][1] = i + 1
        else:
            past = min(j for j in range(system, i + 1) if start[j] >= start[i] - history)
            spans.append([i, i + 1, past if end - start[past] <= room else i])
    spans = spans or [[1, 1, 1]]
    return ["".join(written[:system] + written[past:end]) for _, end, past in spans]


def test_op1_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    said = "</s>[INST] ok [/INST]"
    turns = collections.defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    turns[-7] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: tuple(r)[1:] for r in Q.op1_chat_format(spark, sf).collect()}
    for k, ts in turns.items():
        loss = "".join(t for ro, t in ts if ro == "assistant")
        want = (len(ts), sha("".join(f"{ro}\n{t}\n" for ro, t in ts)), len(loss), sha(loss), sum(map(len, plain_windows(ts))))
        assert got.pop(k) == want, k
    assert not got
    windows = chat_format.formatted(spark.read.parquet(f"{sf}/conversations.parquet"), budget=900, history=300).collect()
    for k, ts in turns.items():
        if k != -7:
            mine = [r["formatted"] for r in sorted((r for r in windows if r["conv_id"] == k), key=lambda r: (r["window"]["b"], r["window"]["w"]))]
            assert mine == plain_windows(ts, 900, 300)


def test_chat_of_awkward_tables(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "yes"), (1, 2, "assistant", "yes"), (1, None, None, "first"), (None, 1, "user", "x" * 200_000), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for c in ("conv", "head", "body", "tokens", "no", "to", "start", "system", "past", "block", "last", "b", "w", "t", "s", "p", "r", "window", "formatted"):
        df = df.withColumn(c, F.lit("mine"))
    got = collections.defaultdict(list)
    for r in chat_format.read_back(chat_format.formatted(df)).collect():
        got[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
    assert got == {1: [("", "first"), ("system", "be kind"), ("user", ""), ("assistant", "yes"), ("assistant", "yes")], None: [("user", "x" * 200_000)], 2: [("assistant", "")]}


def test_chat_query_has_the_control_conversation(spark, sf):
    said = "</s>[INST] ok [/INST]"
    r = Q.op1_chat_format(spark, sf).where("conv_id = -7").first()
    assert r["n_turns"] == 2 and r["loss_sha256"] == sha(said) and r["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n")


# ---------------------------------------------------------------- 2 decontamination


@pytest.mark.parametrize("few", [0, 50_000])
def test_contamination_of_awkward_tables(spark, awkward, empty, few):
    items = spark.createDataFrame([(1, "two"), (2, None), (3, ""), (4, "ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet")], "item_id long, text string")
    rows = decontamination.contamination(awkward, items, few=few).collect()
    assert len(rows) == len(AWKWARD) and rows[0]["key"] == "mine"
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows}
    assert got[(3, 2)] == (1, ["1"], True) and got[(1, 0)] == (0, [], False)
    assert got[(5, 20_000)][0] == 20_000 - 1 - 0 and got[(5, 20_000)][1] == ["4"]
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(awkward, items.where("false")).where("contaminated").count() == 0


def test_contamination_without_broadcasts(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got, want = (sorted(tuple(r) for r in decontamination.contamination(docs.select("doc_id", "text"), items, few=few).drop("text").collect()) for few in (0, 50_000))
    assert got == want and any(r[-1] for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    lists, exact = decontamination.matches(docs, items)
    assert exact.count() == 1 and decontamination.near(lists, 3).select("doc").distinct().count() == 2
    # the item's first word is in no document, its second one is replaced in document 4
    docs = spark.createDataFrame([(3, "x y one two three four five"), (4, "one other three four five"), (5, "five one"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "absent one two three four five")], "item_id long, text string")
    got = {(r["doc_id"], r["item"], r["start"]) for r in decontamination.proximity(docs, items, slack=1).collect()}
    assert {(3, "9", 1), (4, "9", -1)} <= got and not any(d in (5, None) for d, _, _ in got)


# ---------------------------------------------------------------- 3 line dedup


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_keys():
    rng = random.Random(2)
    for t in (1, 2, 3):
        keys = line_dedup.Keys(t)
        for _ in range(3000):
            a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 24)))
            b = list(a)
            for _ in range(rng.randint(0, 5)):
                i = rng.randrange(len(b) + 1)
                b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
            b = "".join(b)
            near = edit(a, b) <= t
            assert line_dedup.within(a, b, t) == near
            if near and min(len(a), len(b)) > t:
                (oa, pa), (ob, pb) = (tuple(map(set, keys.of(x))) for x in (a, b))
                assert oa & ob or oa & pb or ob & pa


@pytest.mark.parametrize("group, most", [(line_dedup.GROUP, line_dedup.BROADCAST_BYTES), (5, line_dedup.BROADCAST_BYTES), (line_dedup.GROUP, 0)])
def test_line_dedup_brute_force(spark, monkeypatch, group, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 60))) for _ in range(40)]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(5):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        docs.append((k, "\n".join(lines)))
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), group=group).collect()}
    before: list[str] = []
    for k, t in docs:
        kept = []
        for line in t.split("\n"):
            near = len(line) >= line_dedup.LEAST and any(len(o) >= line_dedup.LEAST and abs(len(line) - len(o)) <= 2 and edit(line, o) <= 2 for o in before)
            if not (line and line in before or near):
                kept.append(line)
            before.append(line)
        assert out[k] == "\n".join(kept), k


def test_op3_removes_equal_short_lines(spark, sf):
    seen, want = set(), {}
    for k, t in sorted(documents(spark, sf)):
        short = [line for line in (t or "").split("\n") if 0 < len(line) < line_dedup.LEAST]
        want[k] = sum(line in seen or line in short[:i] for i, line in enumerate(short))
        seen.update(short)
    assert sum(want.values()) > 0
    plain = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated(spark.read.parquet(f"{sf}/documents.parquet"), exact=line_dedup.LEAST).collect()}
    got = {r["doc_id"]: r["n_removed"] for r in Q.op3_line_dedup(spark, sf).collect()}
    assert got == {k: plain[k] + n for k, n in want.items()}


def test_line_dedup_of_lines_whose_segments_repeat():
    import pyarrow as pa

    arrow = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("no", pa.int32())])
    lines = [("Chapter %02d " % i) + "." * (40 + i % 2) for i in range(20)]
    # of lines that own the key, every second one also probes it; the longer ones only probe
    rows = [(own, i, line) for i, line in enumerate(lines) for own in ((True, False) if i % 4 == 0 else (i % 2 == 0,))]
    cols = list(zip(*rows))
    table = pa.table({"own": pa.array(cols[0]), "id": pa.array(cols[1], pa.int64()), "h": pa.array([0] * len(rows), pa.int64()), "no": pa.array([0] * len(rows), pa.int32()), "line": pa.array(cols[2]), "block": pa.array([0] * len(rows), pa.int32())})
    got = line_dedup.similar(2, arrow)(None, table).column("id").to_pylist()
    own = [i % 2 == 0 for i in range(20)]
    assert got == [y for y in range(20) if any((own[x] or own[y]) and edit(lines[x], lines[y]) <= 2 for x in range(y))]


def test_line_dedup_of_awkward_tables(awkward, empty):
    rows = line_dedup.deduplicated(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r["h"] for r in rows} == {"mine"}
    assert next(r["text"] for r in rows if r["doc_id"] == 1) is None
    assert line_dedup.deduplicated(empty).count() == 0
    dated = awkward.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")).alias("doc_id"), "text", "n")
    want = sorted((r["n_removed"] for r in rows))
    assert sorted(r["n_removed"] for r in line_dedup.deduplicated(dated).collect()) == want


# ---------------------------------------------------------------- 4 toxicity


def test_toxicity_learns_the_word_not_the_group(spark):
    rng = random.Random(5)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = lambda *w: " ".join(rng.sample(filler, 12) + list(w)) + "."
    rows = [(i, text("idiot", *(["muslims"] if i % 2 else [])), 1) for i in range(0, 100)] + [(i, text(*(["christians"] if i % 5 == 0 else [])), 0) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fitted(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    test = spark.createDataFrame([(1, text("idiot")), (2, text("muslims")), (3, text("christians")), (4, text())], "i int, text string")
    s = {r["i"]: r["s"] for r in test.select("i", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert s[1] > 0.7 and max(s[2], s[3], s[4]) < 0.5 and abs(s[2] - s[3]) < 0.2
    pairs = toxicity.swapped("The muslims came. Nothing here.\nBlack cats!")
    assert pairs == [("The muslims came.", "The christians came."), ("Black cats!", "white cats!")]


def test_toxicity_without_labels(spark, awkward, empty):
    model = toxicity.fitted(awkward, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    rows = awkward.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["s"] <= 1 for r in rows)
    assert toxicity.fitted(empty, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}
    # a key with several labels does not multiply its text
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (3, 0), (3, 0), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fitted(awkward, labels)
    assert abs(model.intercept) < 20 and awkward.select(toxicity.score(F.col("text"), model)).count() == len(AWKWARD)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in Q.op4_toxicity(spark, sf).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[d]["predicted"], t) for d, t in labels if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    hits = sum(p and t for p, t in held)
    assert hits / sum(t for _, t in held) > 0.6 and hits / sum(p for p, _ in held) > 0.9


# ---------------------------------------------------------------- 5 fingerprints


def shingles(t):
    w = (t or "").translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, sf):
    rows = sorted(documents(spark, sf), reverse=True)
    got = {r["doc_id"]: r for r in Q.op5_fingerprints(spark, sf).collect()}
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b = shingles(t), shingles(edited)
        assert got[k]["edited_sha256"] == sha(edited) and got[k]["n_chars"] == len(t)
        assert abs(got[k]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        c = shingles(after)
        assert abs(got[k]["near_next"] - (len(a & c) / len(a | c) if a | c else 1)) < 0.2
        of = lambda x: fingerprints.encode(fingerprints._sketch_text(x, fingerprints.WordHash(), fingerprints.K, 5))
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (of(t), of(edited))
    a, b = (np.arange(x, x + 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (0, 500))
    h = [fingerprints.sketch(x) for x in (a, b, np.concatenate((a, b)))]
    assert (fingerprints.merge(h[0], h[1]) == h[2]).all()
    assert abs(fingerprints.resemblance(h[0], h[1]) - 1 / 3) < 0.15 and abs(fingerprints.distinct(h[2]) / 1500 - 1) < 0.3 and abs(fingerprints.containment(h[0], h[1]) - 0.5) < 0.2
    assert (fingerprints.decode(fingerprints.encode(h[0])) == h[0]).all()


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_fingerprints_follow_the_order_in_many_runs(spark, kind):
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(20)]), rng.choice(["", "same text", f"text {i} of these"]) + rng.choice(["", " and", " more"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(5)
    of = {"string": F.format_string("%03d", "k"), "int": F.col("k"), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("k"))}[kind]
    df = df.select(F.when(F.col("k").isNotNull(), of).alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    order = df.orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc()).collect()
    want = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        cut = len(a["text"]) // 3
        want[a["doc_id"], len(a["text"]), sha(a["text"][: len(a["text"]) - cut] + b["text"][:cut])] += 1
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.edited_pairs(df, run=500).collect())
    assert got == want


def test_fingerprints_of_awkward_tables(spark, awkward, empty):
    rows = fingerprints.edited_pairs(awkward).collect()
    assert len(rows) == len(AWKWARD) and len({r["fingerprint"] for r in rows if r["doc_id"] in (3, 7)}) == 1
    assert fingerprints.edited_pairs(empty).count() == 0
    one = fingerprints.edited_pairs(awkward.where("doc_id = 3")).first()
    assert one["near_next"] == 1
    parts = fingerprints.fingerprinted(spark.createDataFrame([("g", "a b c d e f"), ("g", "c d e f g h")], "g string, text string"))
    whole = fingerprints.merged(parts, ["g"]).first()["fingerprint"]
    assert len(fingerprints.decode(whole)) == 4
    texts = [" ".join(f"w{i * 7 + j}" for j in range(60)) for i in range(40)] + [""] * 3
    parts = fingerprints.fingerprinted(spark.createDataFrame([(None, "", t) for t in texts] + [("e", "mine", "")], "g string, __h string, text string").repartition(7))
    got = {r["g"]: r["fingerprint"] for r in fingerprints.merged(parts, ["g"]).collect()}
    both = np.concatenate([fingerprints._sketch_text(t, fingerprints.WordHash(), 128, 5) for t in texts])
    assert got == {None: fingerprints.encode(np.unique(both)[:128]), "e": ""}
    assert parts.select(fingerprints.estimates(F.col("fingerprint"), F.col("fingerprint")).alias("e")).first()["e"]["resemblance"] == 1


# ---------------------------------------------------------------- 6 language model


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_brute_force(spark, sf, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK", 20_000)
    rows = documents(spark, sf)
    if order == kneser_ney.ORDER:
        out = Q.op6_kneser_ney(spark, sf)
    else:
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held_out"))
        out, model = kneser_ney.scored_by(docs, ~F.col("held_out"), order=order)
        out = out.withColumn("train_tokens", F.lit(model.total))
    got = {r["doc_id"]: r for r in out.collect()}
    seq = {k: [*[b" "] * (order - 1), *words_of(t), b" "] for k, t in rows}
    train = [w for k, w in seq.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    grams = lambda w, k: (tuple(w[i - k + 1 : i + 1]) for i in range(order - 1, len(w)))
    c1 = collections.Counter(g for w in train for g in grams(w, 1))
    n, v = sum(c1.values()), len(c1)
    # the highest order counts occurrences, every other one the n-grams that it ends
    count = {order: collections.Counter(g for w in train for g in grams(w, order))}
    for k in range(order - 1, 0, -1):
        count[k] = collections.Counter(g[1:] for g in count[k + 1])
    D = {k: kneser_ney.discounts([sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]) for k, c in count.items()}
    total, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for k in range(2, order + 1):
        for g, c in count[k].items():
            total[k, g[:-1]] += c
            kinds[k, g[:-1]][min(c, 3) - 1] += 1
    pairs = sum(count[1].values())
    low = sum(D[1][min(x, 3) - 1] for x in count[1].values()) / pairs
    of = lambda c, t: t[min(c, 3) - 1] if c else 0

    def p(g):
        k = len(g)
        c = count[k][g]
        if k == 1:
            return (c - of(c, D[1])) / pairs + low / (v + 1)
        t = total[k, g[:-1]]
        return (c - of(c, D[k]) + sum(i * j for i, j in zip(D[k], kinds[k, g[:-1]])) * p(g[1:])) / t if t else p(g[1:])

    for c in (b" ", b"the", b"?"):
        context = (*[b" "] * (order - 2), c)
        assert abs(sum(p((*context, *y)) for y in c1) + p((*context, b"? ?")) - 1) < 1e-9
    base = score = 0
    for k, w in seq.items():
        r = got[k]
        s, b = sum(math.log10(p(g)) for g in grams(w, order)), sum(math.log10((c1[g] + 1) / (n + v + 1)) for g in grams(w, 1))
        assert abs(r["score"] - s) < 1e-6 * abs(s) and abs(r["base_score"] - b) < 1e-6 * abs(b)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) - order + 1, sum(g in c1 for g in grams(w, 1)), n)
        if r["held_out"]:
            base, score = base + b, score + s
    assert score > base


def test_n_gram_tables():
    rng = np.random.default_rng(4)
    for size, n in ((3, 2000), (200, 5000), (1 << 40, 500)):
        dtype = np.uint64 if size > 1 << 32 else np.uint32
        raw = [rng.integers(0, size, n).astype(np.uint64) for _ in range(3)]
        raw[0][: n // 2] = raw[0][0]
        want = collections.Counter(zip(*(c.tolist() for c in raw)))
        for base in (None, rng.integers(1, 1 << 34, n).astype(np.uint64)):
            cols, counts = kneser_ney.summed(raw, base, size)
            assert list(zip(*(c.tolist() for c in cols))) == sorted(want)
            if base is None:
                assert counts.tolist() == [want[k] for k in sorted(want)]
            back, again = kneser_ney.spread(kneser_ney.squeezed(cols, counts, dtype), 3, dtype)
            assert all((a == b).all() for a, b in zip(back, cols)) and (again == counts).all()
            data, _ = kneser_ney.Table.made(cols[:-1], cols[-1], counts, dtype)
            table = kneser_ney.Table(np.frombuffer(data, np.uint8), dtype)
            key = kneser_ney.context_hash(cols[:-1])
            order = np.argsort(key, kind="stable")

            def look(keys, words, table=table, size=size):
                count, stats = np.zeros(len(keys)), np.zeros((len(keys), 4))
                hit, c, x = table.look(keys, words, size)
                count[hit], stats[hit] = c, x
                return count, stats

            got, stats = look(key[order], cols[2][order].astype(dtype))
            assert (got == counts[order]).all()
            sums = collections.defaultdict(lambda: [0, 0, 0, 0])
            for u, w, c in zip(cols[0].tolist(), cols[1].tolist(), counts.tolist()):
                t = sums[u, w]
                t[0] += c
                t[min(c, 3)] += 1
            assert stats.astype(np.int64).tolist() == [sums[u, w] for u, w in zip(cols[0][order].tolist(), cols[1][order].tolist())]
            absent = kneser_ney.context_hash([np.array([size + 5], np.uint64)] * 2)
            assert look(absent, np.zeros(1, dtype))[1].sum() == 0 and look(key[order][:1], np.array([size], dtype))[0].sum() == 0


def test_kneser_ney_of_awkward_tables(awkward, empty):
    out, model = kneser_ney.scored_by(awkward, F.col("doc_id") != 3)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows) and {r["h"] for r in rows} == {"mine"}
    nothing, model = kneser_ney.scored_by(awkward, F.lit(False))
    assert model.total == 0 and nothing.count() == len(AWKWARD)
    assert kneser_ney.scored_by(empty, F.lit(True))[0].count() == 0


# ---------------------------------------------------------------- 7 Jaccard join


def brute_components(rows, percent=75):
    sets = {k: shingles(t) for k, t in rows}
    where = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    both = collections.Counter((a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[:i])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("most", [jaccard_join.CLUSTER, 300])
def test_jaccard_join_brute_force(spark, most):
    rows = documents(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(docs, most=most).collect()}
    assert got == brute_components(rows)


def families(rng, groups, copies, words, edits):
    """Sets of numbers: groups of copies, each with up to so many edits."""
    out = []
    for _ in range(groups):
        base = rng.choice(10**6, words, replace=False)
        for _ in range(copies):
            s = set(base.tolist())
            for _ in range(int(rng.integers(0, edits + 1))):
                s.discard(int(rng.choice(base)))
                s.add(int(rng.integers(10**6)))
            out.append(np.array(sorted(s), np.uint64))
    return out


def linked(a, b):
    n = len(np.intersect1d(a, b))
    return 100 * n >= 75 * (len(a) + len(b) - n)


def test_regions_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    for sets in (families(rng, 12, 25, 60, 13), families(rng, 1, 200, 60, 4), families(rng, 150, 2, 8, 1)):
        every = {(i, j) for i, a in enumerate(sets) for j in range(i) if linked(a, sets[j])}
        pairs = lambda region: [tuple(sorted((x, y), reverse=True)) for x, ys in region.links() for y in ys.tolist()]
        for leaf, pivots in ((8, 8), (2, 5), (1000, 8)):
            region = jaccard_join.Region(sets, 75)
            region.LEAF, region.PIVOTS = leaf, pivots
            got = pairs(region)
            assert len(got) == len(set(got)) and set(got) == every
        assert leaf == 1000 or region.compared < len(sets) ** 2 / 4
        side = rng.random(len(sets)) < 0.5
        got = pairs(jaccard_join.Region(sets, 75, side=side))
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in every if side[i] != side[j]}
        guest = rng.integers(0, 8, len(sets))
        got = pairs(jaccard_join.Region(sets, 75, guest))
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in every if not guest[i] & guest[j]}
    # families that lie far apart are parted, not compared
    region = jaccard_join.Region(families(rng, 40, 10, 60, 3), 75)
    assert sum(len(ys) for _, ys in region.links()) == 40 * 45 and region.compared < 400 * 399 / 2 / 3


def test_jaccard_join_of_thousands_of_near_copies(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(1500):
        t = list(words)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(50)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    # a chain: each document shares a rare passage with the next one, none is near another
    texts += [" ".join([f"c{i}x{j}" for j in range(8)] + [f"a{i}y{j}" for j in range(40)] + [f"c{i + 1}x{j}" for j in range(8)]) for i in range(300)]
    made = {}
    saved = jaccard_join.saved

    def counted(df, what):
        out = saved(df, what)
        made.setdefault(what, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "saved", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.joined(docs, most=3000).collect()}
    # every round deals at most half as many rows again, and members of blocks are stored once
    assert all(b <= 2 * a for a, b in zip(made["members"], made["members"][1:])) and made["files"][0] > 10
    sets = [shingles(t) for t in texts]
    number = {x: i for i, x in enumerate(set().union(*sets))}
    m = np.zeros((len(texts), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    near = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    assert [got[i][1] for i in range(len(texts))] == (near.sum(1) - 1).astype(int).tolist()
    assert all(got[i][0] == (0 if i < 1500 and near[i].sum() > 1 else i) for i in range(len(texts)))


def test_jaccard_join_of_awkward_tables(awkward, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(awkward).collect()]
    assert len(got) == len(AWKWARD)
    assert {c for d, _, c in got if d in (3, 7)} == {3} and (1, 0, 1) in got and (2, 0, 2) in got
    assert jaccard_join.joined(empty).count() == 0
    named = awkward.withColumn("doc_id", F.format_string("k%s", F.col("doc_id")))
    got = {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.joined(named).collect()}
    assert {("k7", "k3", 2), ("k3", "k3", 2), ("k1", "k1", 0)} <= got
    keyless = jaccard_join.joined(awkward.withColumn("doc_id", F.lit(None).cast("int"))).collect()
    assert len(keyless) == len(AWKWARD) and {r["component_id"] for r in keyless} == {None} and sorted(r["n_links"] for r in keyless)[-3:] == [2, 2, 2]


@pytest.mark.parametrize("most", [2500, jaccard_join.CLUSTER])
def test_jaccard_counts_every_link(spark, most):
    rng = random.Random(8)
    texts = []
    for g in range(3):
        words = [f"w{g}x{i}" for i in range(60)]
        for _ in range(50):
            t = list(words)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
            texts += [" ".join(t)] * rng.choice([1, 1, 1, 2])
    texts += ["", None, "alone here"]
    sets = [shingles(t) for t in texts]
    want = {i: sum(bool(a) and i != j and 4 * len(a & b) >= 3 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.joined(docs, most=most).collect()}
    assert got == want and max(want.values()) > 20


# ---------------------------------------------------------------- 8 SentencePiece


def test_encoding_equals_the_library(spark, sf, awkward, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    model = sentencepiece_bpe.PieceModel(Q.piece_model())
    rng = random.Random(1)
    letters = "ab e▁ \t\n\x00é😀中thing the  <s></s>ñ1234,."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * k + s for k in range(40) for s in ("", "a", "😀", "the ")] + ["".join(rng.choice(list(model.ids)) for _ in range(rng.randint(1, 10))) for _ in range(3000)]
    texts += [t for _, t in documents(spark, sf)]
    flat, ends = [], []
    for t in texts:
        ids = np.frombuffer(model.encode(t), np.int32).tolist()
        assert ids == sp.encode(t), t
        flat += [*ids, 2]
        ends.append(len(flat))
    said = model.decode_rows(np.array(flat, np.int32), np.array(ends)).to_pylist()
    for a, b, got in zip([0, *ends], ends, said):
        assert got == sp.decode(flat[a:b]) == model.decode(flat[a:b])
    # any ids: bytes that spell no character, control ids, white space in front
    some = [*model.byte_id.values()] * 3 + [model.byte_id[x] for x in "é中😀".encode()] * 40 + [0, 1, 2, *rng.sample(range(3, 32000), 60)]
    lists = [[rng.choice(some) for _ in range(rng.randint(0, 12))] for _ in range(5000)]
    ends = np.cumsum([len(x) for x in lists])
    assert model.decode_rows(np.array(sum(lists, []), np.int32), ends).to_pylist() == [sp.decode(x) for x in lists]
    rows = sentencepiece_bpe.tokenized(awkward, Q.piece_model()).collect()
    assert len(rows) == len(AWKWARD) and all(r["ids"][-1] == 2 for r in rows) and rows[0]["ids"] == [2] and rows[0]["h"] == "mine"
    assert sentencepiece_bpe.tokenized(empty, Q.piece_model()).count() == 0


def test_op8_equals_the_library_and_decodes_its_ids(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    want = {}
    for k, t in documents(spark, sf):
        ids = [*sp.encode(t or ""), 2]
        want[k] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in Q.op8_sentencepiece(spark, sf).collect()}
    assert got == want
    # another id gives another text
    rows = sentencepiece_bpe.tokenized(spark.createDataFrame([(1, "the quick fox"), (2, None)], "i int, text string"), Q.piece_model())
    changed = rows.withColumn("ids", F.transform("ids", lambda x, i: F.when(i == 1, 1000).otherwise(x)))
    got = {r["i"]: r["decoded"] for r in sentencepiece_bpe.decoded_ids(changed, Q.piece_model()).collect()}
    same_ = {r["i"]: r["decoded"] for r in sentencepiece_bpe.decoded_ids(rows, Q.piece_model()).collect()}
    assert same_ == {1: "the quick fox", 2: ""} and got[1] != same_[1] and got[1] == sp.decode(changed.where("i = 1").first()["ids"])


# ---------------------------------------------------------------- 9 PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    rng = random.Random(5)
    letters = ["a@b.c", "_d@e.f", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111", " ", "-", "+1 (234) 567-8901", "+", "(", "é😀", ".", "x", "12", "@", "0", "\n", "(644) 555-7859", "٣"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))) for i in range(1500)] + [(5000, None), (5001, "1 " * 20000), (5002, "a" * 100000), (5003, "1." * 30000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in Q.op9_pii(spark, str(tmp_path)).collect()}
    for k, t in rows:
        want = [f"{kind}:{m.start()}:{m.end()}" for kind in PATTERNS for m in re.finditer(PATTERNS[kind], t or "") if passes(kind, m[0])]
        assert got[k]["base_sha256"] == sha(",".join(want)), t
        assert set(want) <= set(got[k]["spans"].split(",")) or not want
        assert [got[k][f"n_{x}"] for x in PATTERNS] == [sum(w.startswith(x) for w in want) for x in PATTERNS]


def test_matches_and_what_surrounds_them(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a1", "é😀", " ", "b", "22", "x33y"]) for _ in range(n)) for n in (0, 1, 5, 40, 1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", pii.located(F.col("t"), "[0-9]+").alias("m")).collect():
        t = texts[r["i"]]
        want = [(m.start(), m.end(), m[0], t[max(0, m.start() - 24) : m.start()]) for m in re.finditer("[0-9]+", t)]
        assert [(m["start"], m["end"], m["s"], m["before"]) for m in r["m"]] == want
        assert all(t[m["end"] : m["end"] + 4].startswith(m["after"][:2]) and len(m["after"]) <= 4 for m in r["m"])
    spans = [[tuple(sorted(rng.sample(range(900), 2))) for _ in range(n)] for n in (0, 1, 3, 40, 700)]
    short = lambda xs: [(a, min(b, a + 9), "", "", "") for a, b in xs]
    kind = pii.MATCH
    for loose in spans:
        for base in spans:
            df = spark.createDataFrame([(short(loose), short(base))], f"l {kind}, b {kind}")
            got = [(x["start"], x["end"]) for x in df.select(pii.apart(F.col("l"), F.col("b")).alias("x")).first()["x"]]
            assert got == sorted((a, b) for a, b, *_ in short(loose) if not any(c < b and a < d for c, d, *_ in short(base)))


def test_many_spans_in_one_text_take_linear_time(spark):
    import time

    took = []
    for n in (2_000, 100_000):
        df = spark.createDataFrame([(1, " ".join(f"10.{i % 200}.{i % 99}.7" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.spans(df).select(F.size("spans")).first()[0] == n
        took.append(time.time() - began)
    assert took[1] < 60, took


def test_weak_supervision_adds_spans(spark, awkward, empty):
    rows = [(1, "please call (644) 555-7859 today"), (2, "mail me: joe (at) site (dot) com."), (3, "x123-456-7890y")] + [(10 + i, f"contact user{i}@mail.com or +1 (234) 567-8{i:03d} thanks") for i in range(100)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [(3, 12, 26)] and got[2] == [(0, 9, 32)] and got[3] == []
    assert pii.spans(awkward).count() == len(AWKWARD) and pii.spans(empty).count() == 0


# ---------------------------------------------------------------- 10 WARC


def test_salvage():
    records = [warc.page_record(i, f"http://x/{i}", bytes([65 + i]) * (500 + i), None) for i in range(8)]
    members = [warc.member(r) for r in records]
    read = lambda data: [(k, o, n, (h or {}).get("feedloom-key")) for k, o, n, h, *_ in warc.salvage(io.BytesIO(data))]
    whole = b"".join(members)
    assert [x[3] for x in read(whole)] == [str(i) for i in range(8)]
    assert [x[3] for x in read(b"".join(records))] == [str(i) for i in range(8)]
    at = [sum(map(len, members[:i])) for i in range(9)]
    hurt = bytearray(whole)
    hurt[at[2] + 20 : at[2] + 40] = b"\0" * 20
    got = read(bytes(hurt))
    assert [x[3] for x in got if x[0] == "record"] == [str(i) for i in range(8) if i != 2]
    assert [(o, n) for k, o, n, _ in got if k == "gap"] == [(at[2], len(members[2]))]
    got = read(b"junk" + whole[: at[7] + 30])
    assert [x[3] for x in got if x[0] == "record"] == [str(i) for i in range(7)] and [k for k, *_ in got].count("gap") == 2
    plain = bytearray(b"".join(records))
    plain[len(records[0]) + 3] = 0
    assert [x[3] for x in read(bytes(plain)) if x[0] == "record"] == [str(i) for i in range(8) if i != 1]
    bad = records[0].replace(b"AAAA", b"AAAB", 1)
    assert [k for k, *_ in read(warc.member(bad) + members[1])] == ["gap", "record"]
    assert read(b"") == [] and gzip.decompress(members[0]) == records[0]


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "same " * 40 if i % 3 == 0 else f"page {i}" * 30) for i in range(30)] + [(100, None, None), (101, "u", "tiny"), (102, "u", "tiny"), (103, "u\r\nX: y", "z" * 200_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in Q.op10_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, _, h in rows:
        again = k % 3 == 0 and 0 < k < 30
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("revisit", 0) if again else ("response", None))
        assert got[k]["payload_digest"] == sha(h or "") and got[k]["payload_bytes"] == len(h or "")


def test_salvage_checks_standard_digests(tmp_path):
    import base64

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = b"<html>" + b"A" * 3000
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    kind = ("Content-Type", "application/http; msgtype=response")
    sound = [
        warc.record("response", [kind, ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest())], http + body),
        warc.record("response", [kind, ("WARC-Payload-Digest", sha1(body))], http + body),
        warc.record("response", [kind, ("WARC-Block-Digest", sha1(http + body)), ("WARC-Payload-Digest", "xyz:unknown")], http + body),
        warc.record("resource", [("Content-Type", "text/html"), ("WARC-Payload-Digest", sha1(body)), ("X-Folded", "a\r\n b")], body),
    ]
    for r in sound:
        for wrap in (warc.member, bytes):
            ((kind_, _, n, head, block, file, size, at),) = warc.salvage(io.BytesIO(wrap(r)))
            assert kind_ == "record" and block[at:] == body and size == len(block) and file is None and n == len(wrap(r))
            hurt = r.replace(b"AAA", b"AAB", 1)
            (gap,) = warc.salvage(io.BytesIO(wrap(hurt)))
            assert gap[0] == "gap" and gap[3] == {"reason": "digest"}
        # a block of any size goes to a file beyond `inline`, and a damaged one leaves none
        *_, block, file, size, at = next(warc.salvage(io.BytesIO(warc.member(r)), 100, str(tmp_path)))
        assert block is None and open(file, "rb").read()[at:] == body
    assert head["x-folded"] == "a b"
    before = len(list(tmp_path.iterdir()))
    assert next(warc.salvage(io.BytesIO(sound[0].replace(b"AAA", b"AAB", 1)), 100, str(tmp_path)))[0] == "gap"
    assert len(list(tmp_path.iterdir())) == before
    assert warc.target_uri({k.lower(): v for k, v in warc.written_uri(" a%0A\r\nb")}) == " a%0A\r\nb"


def test_salvage_of_random_damage():
    rng = random.Random(6)
    records = [warc.page_record(i, f"http://x/{i}", rng.randbytes(rng.randint(0, 3000)), None) for i in range(40)]
    for pack in (warc.member, bytes):
        parts = [pack(r) for r in records]
        at = [sum(map(len, parts[:i])) for i in range(41)]
        for _ in range(60):
            data = bytearray(b"".join(parts))
            hit = set()
            for _ in range(3):
                i = rng.randrange(len(data))
                data[i] ^= rng.randrange(1, 256)
                hit.add(next(k for k in range(40) if at[k] <= i < at[k + 1]))
            got = list(warc.salvage(io.BytesIO(bytes(data))))
            keys = [h["feedloom-key"] for k, _, _, h, *_ in got if k == "record" and "feedloom-key" in h]
            assert set(map(str, set(range(40)) - hit)) <= set(keys)
            assert [g[1] for g in got] == sorted(g[1] for g in got) and sum(g[2] for g in got) == len(data)


def test_warc_of_awkward_tables(spark):
    same_, other = "same " * 40, "other " * 40
    rows = [(1, same_), (1, other), (3, same_), (3, "unique " * 40), (3, same_), (None, same_), (None, None), (5, None), (5, "tiny"), (6, other)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    for c in ("url", "k", "d", "p", "u", "first", "refers_to", "path", "block"):
        pages = pages.withColumn(c, F.lit("mine"))
    got = warc.round_trip(pages).select(F.element_at("headers", "feedloom-key").alias("k"), "type", F.element_at("headers", "feedloom-refers-to-key").alias("r"), warc.payload_of().cast("string").alias("p")).collect()
    want = [("1", "response", None, same_), ("1", "response", None, other), ("3", "revisit", "1", ""), ("3", "revisit", "1", ""), ("3", "response", None, "unique " * 40)]
    want += [(None, "response", None, same_), (None, "response", None, ""), ("5", "response", None, ""), ("5", "response", None, "tiny"), ("6", "revisit", "1", "")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0
