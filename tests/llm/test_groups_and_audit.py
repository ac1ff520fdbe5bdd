"""Operators 11 to 13 against brute force, on rows with nulls, ties, repeats, empty and long texts."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fablens.llm import filter_audit, ngram_join, spelling
from fablens.llm.common import arrow_batches
from fablens.session import stored
from tests.llm.test_operators import base_rows, frame, near_brute, prose


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- op11 --------------------------------------------------------------------------------------------------------------

def variants_brute(rows, min_count=2, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best is not None and words[best] >= ratio * words[word] else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def variant_rows():
    rng = random.Random(8)
    texts = []
    for base in ("calibrate", "aabbaabb", "résumés", "straßenbahn", "Ünderline", "zzzzzzz", "oooooooo"):
        forms = [base] * 40
        for _ in range(12):
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            letter = rng.choice("abzé")
            forms += [base[:at] + ("" if kind == 0 else letter) + base[at + (kind < 2):]] * rng.randrange(1, 4)
        forms += [base[0] + base, base + base[-1], base[1:], base[:-1]] * 2
        texts.append(" ".join(rng.sample(forms, len(forms))))
    chain = " ".join(["abcdefgh"] * 1000 + ["abcdefgx"] * 90 + ["abcdefyx"] * 8)
    ties = " ".join(["tiebreaka"] * 30 + ["tiebreakb"] * 30 + ["tiebreakc"] * 3)
    long_run = "qwertyuiop" * 5_000
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [
        (50, chain), (51, ties), (52, long_run + " " + long_run), (53, (long_run[:-1] + "x,") * 30), (54, None), (55, ""),
        (None, "calibrate nameless nameless"), (56, "calibrate×calibrate"), (56, "repeated repeated"), (56, "repeated repeated"),
        (57, "UPPERCASE uppercase ÀÉ" + "ÀÉÎÕÜÝÞ àéîõüýþ" * 2),
    ]


def test_variants_against_brute_force(spark):
    rows = variant_rows()
    got = spelling.variant_groups(frame(spark, rows).repartition(4))
    assert plain(got, *COLUMNS) == variants_brute(rows)
    roots = {r["word"]: r["root"] for r in got.collect()}
    assert roots["abcdefyx"] == "abcdefgh"  # by way of a form of its own


def test_variants_of_nothing(nothing, spark):
    assert spelling.variant_groups(nothing).count() == 0
    odd = spark.createDataFrame([(1, "walking walking", "x", 2)], "doc_id long, text string, word string, n long")
    assert plain(spelling.variant_groups(odd), *COLUMNS) == variants_brute([(1, "walking walking")])


def test_pieces_and_flushes_do_not_show(spark, monkeypatch):
    rows = variant_rows()[:4]
    monkeypatch.setattr(spelling, "PIECE", 20)
    assert [w for part in spelling.runs(rows[0][1]) for w in part] == re.findall("[A-Za-zÀ-ÿ]+", rows[0][1].lower())
    assert list(spelling.runs("")) == []


# --- op12 --------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("size, percent", [(5, 80), (3, 60), (2, 95)])
def test_join_groups(spark, size, percent):
    rows = base_rows()
    got = ngram_join.join_groups(frame(spark, rows).repartition(5), shingle_words=size, percent=percent)
    want = sorted(((r[0], r[1], r[2]) for r in near_brute(rows, size, percent)), key=repr)
    assert plain(got, "doc_id", "n_shingles", "component_id") == want


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", range(3))
def test_chains_clouds_and_derived_links(spark, monkeypatch, seed):
    """Links that only follow from other members of a list: chains, overlapping clouds, no original among the copies."""
    rng = random.Random(seed)
    rows, number = [], 0
    for cloud in range(3):
        text = prose(50 + cloud + 10 * seed, 120).split()
        for _ in range(25):
            rows.append((number, edited(text, rng, rng.randrange(0, 5))))
            number += 1
        step = text
        for _ in range(12):  # each is near the one before it
            step = edited(step, rng, 2).split()
            rows.append((number, " ".join(step)))
            number += 1
    rng.shuffle(rows)
    monkeypatch.setattr(ngram_join, "SETS_PER_SALT", 4)
    derived = []
    real = ngram_join._derived
    monkeypatch.setattr(ngram_join, "_derived", lambda *a: derived.append(1) or real(*a))
    got = ngram_join.join_groups(frame(spark, rows).repartition(4), shingle_words=5, percent=80)
    want = sorted(((r[0], r[1], r[2]) for r in near_brute(rows, 5, 80)), key=repr)
    assert plain(got, "doc_id", "n_shingles", "component_id") == want
    assert derived or seed == 2  # there all links follow from the leaders


def test_derived_overlaps_are_those_of_the_sets(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = {i: edited(base, rng, i) for i in range(1, 12)}
    sets = {i: set(ngram_join.shingles(t.encode(), 1).tolist()) for i, t in texts.items()}
    leader = 1
    frame_of = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "node long, text binary")
    pairs = spark.createDataFrame([(leader, i) for i in texts if i != leader], "leader long, other long")
    answers = ngram_join._compared(pairs, frame_of, 1, 80).cache()
    assert answers.count() == len(texts) - 1
    asked = [(a, b) for a, b in itertools.combinations([i for i in texts if i != leader], 2)]
    for percent in (85, 93):
        got = ngram_join._derived(spark.createDataFrame(asked, "a long, b long"), answers, percent).collect()
        assert {(r.a, r.b): r.linked for r in got} == {
            (a, b): 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a, b in asked
        }


def test_join_of_nothing_and_odd_columns(nothing, spark):
    assert ngram_join.join_groups(nothing).count() == 0
    odd = spark.createDataFrame(
        [(1, "a b c d e f", 1, 2, 3), (2, "A b c d e f", 1, 2, 3), (None, "a b c d e f", 1, 2, 3), (3, "  ", 1, 2, 3)],
        "doc_id long, text string, node long, digest long, print long",
    )
    got = plain(ngram_join.join_groups(odd), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 2, 1), (2, 2, 1), (None, 2, 1), (3, 0, 3)], key=repr)


# --- op13 --------------------------------------------------------------------------------------------------------------

def audit_brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    documents = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        good = any(i == doc_id and q == 1 for i, q, _ in labels) and doc_id is not None
        toxic = any(i == doc_id and t == 1 for i, _, t in labels) and doc_id is not None
        documents.append((lang or "", fails, good, toxic))
    found = Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {d[0] for d in documents}:
            left = [d for d in documents if d[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[1][letter]]
                left = [d for d in left if not d[1][letter]]
                failing = [d for d in documents if d[0] == part and d[1][letter]]
                only = [d for d in failing if sum(d[1].values()) == 1]
                found[part, "".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone), len(only), sum(d[2] for d in gone), sum(d[3] for d in gone),
                )
    shapley = Counter()
    for (part, order, step), values in found.items():
        shapley[part, order[step - 1]] += values[1]
    return sorted(((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in found.items()), key=repr)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    rng = random.Random(9)
    long_text = " ".join(f"word{i}" for i in range(130))
    texts = [
        None, "", "short", long_text, long_text + " #", long_text.upper(), "same " * 150, "SAME $ " * 150, long_text, "É" * 95 + "A" * 10,
        " \t\n\x0b\x0c\r", "nbsp is no space " * 120, "a|b", "Ab cd " * 20, long_text + "\n" + long_text,
    ]
    rows = [(i, texts[i % len(texts)], rng.choice(["en", "de", None, "", "x,y"])) for i in range(60)]
    return rows + [(3, long_text, "en"), (3, long_text, "en"), (None, long_text, "de"), (None, "only here", None)]


def test_audit_against_brute_force(spark, monkeypatch):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (7, None, 1), (999, 1, 1)]
    documents = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, lang string, part string, n long")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "SHARD_ROWS", 7)
    monkeypatch.setattr(filter_audit, "WORDS_PER_BUCKET", 50)
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 64)
    got = filter_audit.audit(documents.repartition(4), labelled)
    assert plain(got, *AUDIT) == audit_brute(rows, labels)


def test_matrix_has_the_words_of_its_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_ROWS", 5)
    monkeypatch.setattr(filter_audit, "WORDS_PER_BUCKET", 20)
    documents = spark.createDataFrame([(i, t, g) for i, (_, t, g) in enumerate(audit_rows())], "doc_id long, text string, lang string")
    matrix, dictionary = filter_audit.document_term_matrix(documents.repartition(3))
    words = {}
    for row in dictionary.collect():
        split = bytes(row["words"] or b"").split()
        assert len(split) == row["size"]
        words |= {row["first"] + i: w.decode() for i, w in enumerate(split)}
    assert len(set(words.values())) == len(words) and sorted(words) == list(range(len(words)))
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    seen = 0
    for shard in matrix.collect():
        for i, document in enumerate(shard["rows"]):
            own = slice(shard["ends"][i], shard["ends"][i + 1])
            assert len(shard["columns"][own]) == len(set(shard["columns"][own]))
            counted = {words[c]: n for c, n in zip(shard["columns"][own], shard["counts"][own])}
            assert counted == Counter(w.decode() for w in texts[document["doc_id"]].encode().split())
            seen += 1
    assert seen == len(texts)


def own_batches(texts, per_batch):
    """Rows as the shards get them: (at, doc_id, part, print, text)."""
    for start in range(0, len(texts), per_batch):
        own = texts[start:start + per_batch]
        at = list(range(start, start + len(own)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(at), pa.array(["en"] * len(own)), pa.array([b"p"] * len(own)), pa.array(own, pa.binary())],
            names=["at", "doc_id", "part", "print", "text"],
        )


def test_shards_are_packed_and_span_batches():
    rng = random.Random(5)
    texts = [" ".join(f"word{rng.randrange(3000)}" for _ in range(400)).encode() for _ in range(400)]
    size = sum(map(len, texts))
    shards = list(filter_audit._shards(size // 4, 1 << 14)(own_batches(texts, 10)))
    assert 4 <= len(shards) <= 6 and sum(len(s.column("rows")[0]) for s in shards) == len(texts)
    assert sum(s.nbytes for s in shards) < 0.6 * size
    assert [len(s.column("rows")[0]) for s in filter_audit._shards(1 << 30, 150)(own_batches(texts, 50))] == [150, 150, 100]


@pytest.mark.parametrize("kind", ["u1", "<u2"])
def test_packed_numbers(kind):
    values = np.array([0, 1, 254, 255, 256, 65534, 65535, 65536, 0, 255, 1 << 31, 7])
    for own in (values, values[:0], values[:3]):
        assert filter_audit._unpacked(filter_audit._packed(own, kind), len(own), kind).tolist() == own.tolist()


def test_matrix_of_wide_gaps_and_high_counts(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(70_000)), "en"), (2, "w69999 " * 300 + "w0 w1 " + "w66000 " * 255, "en"), (3, None, "en")]
    matrix, dictionary = filter_audit.document_term_matrix(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1))
    words = {r["first"] + i: w for r in dictionary.collect() for i, w in enumerate(bytes(r["words"] or b"").decode().split())}
    found = {}
    for shard in matrix.collect():
        for i, document in enumerate(shard["rows"]):
            own = slice(shard["ends"][i], shard["ends"][i + 1])
            found[document["doc_id"]] = {words[c]: n for c, n in zip(shard["columns"][own], shard["counts"][own])}
    assert found == {i: Counter((text or "").split()) for i, text, _ in rows}


def test_audit_gives_a_task_one_shard_and_small_batches(spark, monkeypatch):
    """No task gathers the shards of a partition in one batch or passes matrices from one Python function to another."""
    plans, batches = {}, {}

    def spy(df, name, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        batches[name] = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
        return stored(df, name, **options)

    monkeypatch.setattr(filter_audit, "stored", spy)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    documents = spark.createDataFrame(audit_rows(), "doc_id long, text string, lang string")
    filter_audit.failures(documents)
    assert re.findall(r"\w+InArrow", plans["row-sums"]) == ["FlatMapCoGroupsInArrow"] and "collect_list" not in plans["row-sums"]
    assert batches["shards"] == batches["coded"] == str(filter_audit.BATCH_BYTES) and filter_audit.BATCH_BYTES < filter_audit.SHARD_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_arrow_batches_hold_so_many_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("abcdefgh "), 100).alias("text"))
    with arrow_batches(spark, 1 << 16):
        got = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 2000 and max(r["size"] for r in got) < 1 << 17


def test_audit_of_nothing(nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(nothing, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = filter_audit.audit(one, labels.limit(0))
    assert got.count() == 600 and got.filter(F.col("part") == "").count() == 600


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])
