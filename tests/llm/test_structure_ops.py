"""Suffix dedup, conversation repair and collocations against brute force, on odd rows and in different partitions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import phrases, queries, repair, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("a", T.StringType()), T.StructField("spans", T.LongType()), T.StructField("words", T.LongType()), T.StructField("kept", T.StringType())])
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("cost", T.LongType())])


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], DOCS).repartition(parts)


def against_sql(df, sql, name):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


# suffix dedup


def removed(rows, width):
    """(id, bytes, removed spans, digest) by every string of ``width`` bytes."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        yield doc, len(t), tuple(spans), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


def spans_of(df):
    return sorted(((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), r.kept_sha256) for r in df.collect()), key=repr)


def mixed_texts(width, seed=5):
    """Passages shared whole, in part, with edits, within one text, in copies; runs of one letter; short, empty and null texts."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    passages = [word(rng.randrange(width // 2, width * 9)) for _ in range(12)]
    texts = [None, "", "x", word(width - 1), "z" * (width * 3), "z" * (width + 1), "z" * width + word(20), "ab" * width * 2, passages[0] * 3, passages[1][:width], passages[1]]
    for _ in range(60):
        text = word(rng.randrange(3 * width))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            i = rng.randrange(len(p))
            text += p[i : i + rng.randrange(1, len(p) + 1)] + word(rng.randrange(width))
        texts.append(text)
    base = word(width * 20)
    for _ in range(30):  # near copies of one text, each edited elsewhere
        i = rng.randrange(len(base))
        texts.append(base[:i] + "#" + base[i + rng.randrange(3) :])
    texts += [base, base, base[width:], texts[20], texts[20]]
    return [(i if i % 7 else None, t, "en") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "order", "parts", "bucket"), [(400, 11, 3, 20_000), (40, 3, 5, 3_000), (27, 3, 1, 1 << 20), (61, 5, 4, 500)])
def test_repeated_spans(spark, width, order, parts, bucket):
    rows = mixed_texts(width)
    got = suffix_dedup.repeated_spans(table(spark, rows, parts), width=width, order=order, bucket_bytes=bucket)
    assert spans_of(got) == sorted(removed(rows, width), key=repr)


def test_repeated_spans_in_chunks(spark, monkeypatch):
    """Long texts are summed and flushed in parts: the functions give the same with tiny parts."""
    rows = mixed_texts(400)
    t = max((r[1] or "" for r in rows), key=len).encode()
    places = suffix_dedup.np.arange(len(t) - 399)
    whole = suffix_dedup.prefixes(t, places, 400, suffix_dedup._powers(suffix_dedup.CHUNK + 401))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 97)
    assert (suffix_dedup.prefixes(t, places, 400, suffix_dedup._powers(97 + 401)) == whole).all()


def test_repeated_spans_lawful_texts(spark):
    """Thue and Morse's string of two letters and the same with both changed differ, though their polynomials modulo 2**64 agree."""
    law = lambda x, y: "".join((x, y)[i.bit_count() % 2] for i in range(256))
    rows = [(i, law(*pair) + f"{i // 2:02}" * 72, "en") for i, pair in enumerate(x for p in itertools.combinations("abcdefgjlnpqsvwxyz", 2) for x in (p, p[::-1]))]
    assert not any(spans for _, _, spans, _ in removed(rows, 400))
    assert spans_of(suffix_dedup.repeated_spans(table(spark, rows))) == sorted(removed(rows, 400), key=repr)


def test_repeated_spans_of_many_copies(spark):
    """Rows of one text with many copies come out of several tasks."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "16"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    rows = [(i, "copy " * 90 if i % 2 else f"{i} no copy", "en") for i in range(4000)]
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        got = suffix_dedup.repeated_spans(table(spark, rows, 8)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert sorted((r.doc_id, [tuple(x) for x in r.spans]) for r in got) == [(i, [(0, 450)] if i % 2 else []) for i in range(4000)]
    assert len({r.task for r in got if r.spans}) > 1


def test_repeated_spans_edges(spark):
    assert suffix_dedup.repeated_spans(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(table(spark, []), width=100)
    rows = [(1, "é" * 900, None), (2, None, "en"), (2, "é" * 150 + "x", "en")]
    assert spans_of(suffix_dedup.repeated_spans(table(spark, rows))) == sorted(removed(rows, 400), key=repr)
    kept = suffix_dedup.without_repeats(table(spark, mixed_texts(400)))
    assert kept.columns == ["doc_id", "text", "lang", "a", "spans", "words", "kept", "kept_"]
    expected = sorted((h for *_, h in removed(mixed_texts(400), 400)))
    assert sorted(hashlib.sha256(r.kept_).hexdigest() for r in kept.collect()) == expected


def test_covers():
    for order in (2, 3, 5, 7, 11, 13):
        v, cover = suffix_dedup.difference_cover(order)
        assert len(cover) == order + 1 and {(p - q) % v for p in cover for q in cover} == set(range(v))


def test_op11(spark):
    against_sql(queries.op11_suffix_dedup(spark, SF), suffix_dedup.REMOVAL_SQL, "documents")


# conversation repair


def judged(rows):
    """Rows of one conversation in order, with each turn's first fault."""
    seen, out = set(), []
    for _, turn, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def every_repair(turns):
    """The cheapest repair by trying all edits, with up to two insertions in each gap."""
    gaps = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    choices = [[("D", 3, None)] + ([] if f in ("blank", "duplicate") else [(e, c + (f == "truncated"), r) for e, c, r in (("K", 0, role[:1]), ("R", 2, "u"), ("R", 2, "a"))]) for _, role, _, f in turns]
    best = None
    for edits in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            roles, audit, cost = [], "", 0
            for k, ins in enumerate(inserts):
                roles += ins
                audit += "I" * len(ins)
                cost += 2 * len(ins)
                if k < len(edits):
                    e, c, r = edits[k]
                    audit += e
                    cost += c
                    roles += [r] if r is not None else []
            if re.fullmatch("(s?(ua)+)?", "".join(roles)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


def relaxed(turns):
    """The cheapest repair of longer conversations: relaxation until nothing changes."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {(0, ""): (0, "")}
    for i in range(len(turns) + 1):
        for _ in range(4):
            for (k, q), (c, a) in list(best.items()):
                for r in "ua":
                    if k == i and (q, r) in step:
                        to = (i, step[q, r])
                        best[to] = min(best.get(to, (1 << 60, "")), (c + 2, a + "I"))
        if i < len(turns):
            _, role, _, f = turns[i]
            for (k, q), (c, a) in list(best.items()):
                if k == i:
                    options = [((i + 1, q), (c + 3, a + "D"))]
                    if f not in ("blank", "duplicate"):
                        options += [((i + 1, step[q, r]), (c + w + (f == "truncated"), a + e)) for e, w, r in (("K", 0, role[:1]), ("R", 2, "u"), ("R", 2, "a")) if (q, r) in step]
                    for to, w in options:
                        best[to] = min(best.get(to, (1 << 60, "")), w)
    return min(best[len(turns), q] for q in ("", "a") if (len(turns), q) in best)


def rebuilt(turns, audit):
    """The repaired lines: the only roles that fit the pattern."""
    letters = [e for e in audit if e != "D"]
    rows, out, last = iter(turns), [], ""
    for e in audit:
        role, text = "", ""
        if e != "I":
            _, role, text, _ = next(rows)
        if e == "D":
            continue
        need = "user" if last != "u" else "assistant"
        role = role if e == "K" else need
        out.append(f"{role}:{text}")
        last = role[:1]
    assert len(out) == len(letters) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected_report(rows):
    """Reports by id of rows that are in order within their conversation."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    for conv, held in by.items():
        turns = judged(sorted(held, key=lambda r: (r[1] is not None, r[1] or 0)))
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        counts = [sum(t[3] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = relaxed(turns)
        yield conv, gaps, *counts, illegal, cost, audit, rebuilt(turns, audit)


def random_turns(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((None if c == 0 else c, rng.choice([t * 2, t * 3 + 100, t]) if c % 5 else t, role, rng.choice(["Yes.", "No!", "so on", "", "  \n", None, f"Number {t}.", f"Cut {t}", f"Q {rng.randrange(9)}?  "])))
    # one row for each number of a conversation, or equal rows
    kept = {(r[0], r[1]): r for r in rows}
    return list(kept.values())


def test_small_repairs_by_all_edits():
    for rows in ([(1, t, r, x) for t, (r, x) in enumerate(turns)] for n in (1, 2, 3) for turns in itertools.product([("user", "Q."), ("assistant", "A"), ("system", "S."), ("tool", "")], repeat=n)):
        turns = judged(rows)
        cost, audit, roles = every_repair(turns)
        assert relaxed(turns) == (cost, audit)
        got = repair.repairs([(r[:1], f in ("blank", "duplicate"), f == "truncated") for _, r, _, f in turns], repair.START, True)
        assert got == {repair.GOAL: (cost, audit)}


@pytest.mark.parametrize(("convs", "most", "parts"), [(80, 9, 3), (3, 700, 5), (1, 500, 4)])
def test_repair_report(spark, convs, most, parts):
    rows = random_turns(convs, convs, most)
    rng = random.Random(1)
    rows += [r for r in rows if rng.random() < 0.1]  # repeated rows
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(parts)
    got = sorted((tuple(r) for r in repair.repair_report(df).collect()), key=repr)
    assert got == sorted(expected_report(rows), key=repr)


def test_repair_of_many_equal_rows_and_stretches(spark):
    rows = [(7, None, "user", "Again.")] * 300 + [(7, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(200)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several tasks for one conversation
    try:
        got = [tuple(r) for r in repair.repair_report(df).collect()]
        turns = repair.repaired_turns(df).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == list(expected_report(rows))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == got[0][-1]


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair_report(none).collect() == []
    ids = spark.createDataFrame([(3,), (None,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((tuple(r) for r in repair.repair_report(none, ids).collect()), key=repr) == sorted([(i, 0, 0, 0, 0, 0, 0, "", empty) for i in (3, None)], key=repr)


def test_op12(spark):
    out = []
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        role, text = r.role or " ", " " if r.text is None else r.text
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(r.conv_id, r.turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {r[0]: tuple(r) for r in queries.op12_repair(spark, SF).collect()}
    expected = {r[0]: r for r in expected_report(out)}
    empty = hashlib.sha256(b"").hexdigest()
    for conv in {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}:
        assert got.pop(conv) == expected.get(conv, (conv, 0, 0, 0, 0, 0, 0, "", empty))
    assert not got


# collocations


def brute_collocations(rows, max_words, least, percent, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            score, _, l, r = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def collocation_rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "é", "ÉTÉ", "a" * 300, "x\x00y", " ", "new", "york", "city", "hall"]
    rows = [(None, None, None), (1, "", "en"), (2, " \t,.;\n", "en"), (3, "solo", None)]
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rng.randrange(40)))
        rows.append((i, text + " new york city hall" * rng.randrange(3), rng.choice(["en", "fr", None])))
    return rows + [(900, "buffalo " * 3000, "en"), (901, "na " * 50_000, "fr")]


@pytest.mark.parametrize(("max_words", "least", "top", "bucket"), [(3, 10, 2000, 2_000), (2, 3, 7, 1 << 20), (4, 2, 50, 50_000)])
def test_collocations(spark, max_words, least, top, bucket):
    rows = collocation_rows()
    got = phrases.collocations(table(spark, rows), max_words=max_words, least=least, top=top, bucket_bytes=bucket)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, max_words, least, 50, top)


def test_multikey_quicksort(monkeypatch):
    np = phrases.np
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 6, 3000).astype(np.uint64) for _ in range(3)]
    columns[2][columns[1] == 0] = 0
    weight = rng.integers(1, 5, 3000)
    expected = collections.Counter()
    for *key, w in zip(*columns, weight, strict=True):
        for d in (1, 2, 3):
            if 0 not in key[:d]:
                expected[tuple(map(int, key[:d]))] += int(w)
    for small in (1 << 15, 20):
        monkeypatch.setattr(phrases, "SMALL", small)
        got = {}
        for depth, rows, sizes in phrases.equal_partitions(columns, weight, 60):
            for i, size in zip(rows.tolist(), sizes.tolist(), strict=True):
                got[tuple(int(c[i]) for c in columns[:depth])] = size
        assert got == {k: v for k, v in expected.items() if v >= 60}


def test_hashes_in_chunks(monkeypatch):
    body = b" ".join(b"w%d" % (i * i) for i in range(400)) + b" " + b"long" * 500 + b" w4"
    whole = phrases.suffixes([body], 3)[0]
    monkeypatch.setattr(phrases, "CHUNK", 31)
    assert all((a == b).all() for a, b in zip(phrases.suffixes([body], 3)[0], whole, strict=True))


def test_collocations_of_nothing(spark):
    assert phrases.collocations(table(spark, [])).collect() == []


def test_op13(spark):
    against_sql(queries.op13_collocations(spark, SF), phrases.COLLOCATIONS_SQL, "documents")
