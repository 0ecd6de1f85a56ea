"""Phrases, chat formatting and vector codes against plain models, round trips and odd rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from larkstream.llm import chat_format, phrases, vector_codes
from larkstream.llm.common import drop_folder
from larkstream.llm.perfect_hash import PerfectHash

# ---- phrases


def brute_phrases(rows):
    texts, out = {}, []
    for text, lang in rows:
        texts.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, held in texts.items():
        f, n = Counter(), 0
        for t in held:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.translate({c: c + 32 for c in range(65, 91)})):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                for m in range(1, 5):
                    f.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
        found, over, kept = {g: a for g, a in f.items() if len(g) > 1 and a >= 30}, {}, []
        for g, a in found.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    over[g[i : i + m]] = max(over.get(g[i : i + m], 0), a)
        for g, a in found.items():
            if 100 * over.get(g, 0) < 80 * a:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:2000], 1)]
    return sorted(out)


def talk(seed, n):
    r = random.Random(seed)
    words = ["Über", "a", "b", "c", "die", "New", "york", "city", "x.y", " ", "tab\tbed", "\x1c", "é", "É"]
    rows = []
    for i in range(n):
        t = " ".join(r.choices(words, k=r.randint(0, 40)))
        t += r.choice(["", "\n", "!?", "\x0b", "\r\n"]) + "new york city" * r.randint(0, 2) + " one two three four"
        rows.append((t, r.choice(["en", "de", None, "und", "en", "en"])))
    return [*rows, (None, "en"), ("", None), (" \t\n", "fr"), (" ".join(r.choices(words, k=30_000)), "en"), *[("same old same old same old", "en")] * 40]


@pytest.mark.parametrize("sizes", [phrases.Sizes(), phrases.Sizes(300, 50, 900, 40, 2, 64)])  # the latter: many chunks, slices, batches, blocks and passes
def test_phrases_equal_brute_force(spark, sizes):
    rows = talk(3, 120)
    docs = spark.createDataFrame([(t, g, 1, "k", "w") for t, g in rows], "text string, lang string, n long, chunk string, words string").repartition(5)
    assert sorted(map(tuple, phrases.mine_phrases(docs, sizes=sizes).collect())) == brute_phrases(rows)


def test_no_phrases(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([("a b " * 20, "en")], "text string, lang string")).count() == 0


def test_screen_is_held_folded(spark, monkeypatch):
    sizes, held = phrases.Sizes(300, 50, 900, 40, 2, 64, folded=64, width=256), []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: held.append(value) or send(sc, value))
    rows = talk(5, 120)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert sorted(map(tuple, phrases.mine_phrases(docs, sizes=sizes).collect())) == brute_phrases(rows)
    screens = [x for x in held if isinstance(x, np.ndarray)]
    assert len(screens) == 3 and all(8 * x.nbytes == sizes.folded for x in screens)  # of 1,024 counters and more


def test_memory_of_tables_and_slices_is_bounded():
    assert max(phrases._width(1 << e, phrases.Sizes()) for e in range(10, 31)) <= 1 << 19
    levels, keys = PerfectHash.of(np.arange(1 << 17, dtype=np.int64)).packed()
    tracemalloc.start()
    table = PerfectHash.unpacked(levels, keys)
    own = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(table.keys) == 1 << 17 and own < 1 << 17  # beside what was read: less than a byte a key


def test_row_groups_of_large_rows(spark):
    rows = spark.range(0, 40, 1, 1).select(F.expr("cast(concat_ws('', transform(sequence(1, 25000), x -> sha2(cast(x * 40 + id as string), 256))) as binary)").alias("codes"))
    _, path = phrases.stored(rows, "large", phrases._ROW_GROUPS)
    (part,) = Path(path.removeprefix("file:")).glob("part-*")
    meta = pq.ParquetFile(part).metadata
    assert meta.num_rows == 40 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 24 << 20  # of 64 MB
    drop_folder(spark, path)


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys, others):
    held = np.array(sorted(keys), np.int64)
    for table in (PerfectHash.of(held), PerfectHash.unpacked(*PerfectHash.of(held).packed())):
        assert sorted(table.find(held).tolist()) == list(range(len(keys)))
        assert all((s >= 0) == (k in keys) for k, s in zip(others, table.find(np.array(others, np.int64)).tolist(), strict=True))


# ---- chat

BITS = ["<", "<<", "</", "[", "]", ">", ">>", "\\", "/", "SYS", "INST", "ROLE", "SAYS", "s", "s>", " ", "a", "\n", "é", "[INST]", "</s>", "<s>", "[\\INST]", "<<\\\\SYS>>", " [/INST]", "[SAYS]", "<</SYS>>"]
TEXT = st.lists(st.sampled_from(BITS), max_size=9).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), TEXT), TEXT), max_size=6), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_grammar_round_trip(turns, step):
    whole = "".join(chat_format.format_turn(r, t)[0] for r, t in turns)
    read = chat_format.parse(whole)
    assert [t[:2] for t in read] == turns
    assert all(chat_format.unescape(whole[a:b]) == t for (_, t), (_, _, a, b) in zip(turns, read, strict=True))
    reader, pieces = chat_format.Reader(), []
    for i in range(0, len(whole), step):
        pieces += reader.feed(whole[i : i + step])
    reader.end()
    assert pieces == read


def test_plain_turns_stay_as_they_are():
    assert chat_format.format_turn("user", "see [this] <b>") == ("[INST] see [this] <b> [/INST]", 7, 21, False)
    assert chat_format.format_turn("user", "</s>") == ("[INST] <\\/s> [/INST]", 7, 12, True)
    for bad in ("x", "[INST] a", "[INST] a </s>", "[INST] <s> [/INST]", "[INST]a[/INST]", "[ROLE] a [/ROLE]", "[/INST]"):
        with pytest.raises(chat_format.Unreadable):
            chat_format.parse(bad)


def test_conversations_read_back(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice([None, "", "x", "".join(r.choices(BITS, k=12)), "é" * 5])) for c in (1, 2, None, -7, 9) for t in range(12)]
    rows += [(1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"), (2, None, "user", "no turn"), (4, 0, "assistant", "w" * 300_000)]
    df = spark.createDataFrame([(*x, "p", 1) for x in rows], "conv_id long, turn long, role string, text string, piece string, c int").repartition(4)
    got = {x[0]: tuple(x[1:]) for x in chat_format.read_back(chat_format.format_turns(df)).collect()}
    want = {}
    for c in {x[0] for x in rows}:
        turns = sorted(((t is None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        chars = sum(len(chat_format.format_turn(role, x)[0]) for *_, role, x in turns)
        digest = hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in turns).encode()).hexdigest()
        want[c] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert got == want
    assert chat_format.read_back(chat_format.format_turns(df.where("false"))).count() == 0


# ---- vector codes


def brute_codes(rows):
    """rows: (vec_id, vector, label) of kept vectors of one length that 4 divides."""
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    x = [[v.as_integer_ratio()[0] * 1024 // v.as_integer_ratio()[1] for v in vector] for _, vector, _ in rows]
    width, books, codes, errors = len(x[0]) // 4, [], [""] * len(rows), [0] * len(rows)
    for p in range(4):
        parts = [v[p * width : (p + 1) * width] for v in x]
        book = [list(v) for v in parts[:256]]
        near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
        for _ in range(4):
            of = [near(v, book)[1] for v in parts]
            for e in set(of):
                mine = [v for v, k in zip(parts, of, strict=True) if k == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for i, v in enumerate(parts):
            d, e = near(v, book)
            codes[i] += f"{e:02x}"
            errors[i] += d
        books.append(book)
    of_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        of_label[label] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted((repr(i), c, e, of_label[label], digest) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))


def coded(spark, rows, partitions=3):
    df = spark.createDataFrame([(*x, "r", 1) for x in rows], "vec_id long, embedding array<double>, label int, record string, part int").repartition(partitions)
    return sorted((repr(x[0]), *x[1:]) for x in vector_codes.encode_vectors(df).select("record.vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 70)
    r = random.Random(2)
    good = [(i, [round(r.gauss(0, 0.01), 3) for _ in range(8)], r.choice([0, 1, None])) for i in range(420)]
    good += [(7, good[7][1], 1), (7, good[3][1], 1), (None, good[9][1], None)] + [(1000 + i, [0.0] * 8, 2) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [(-1, None, 0), (-2, [], 0), (-3, [nan] * 8, 0), (-4, [0.0] * 7 + [inf], 0), (-5, [0.0] * 7 + [None], 0), (500, [0.0] * 4, 0)]
    want = brute_codes(good)
    assert coded(spark, good + bad) == want == coded(spark, (good + bad)[::-1], 5)


def test_codes_of_large_components_and_few_vectors(spark):
    rows = [(1, [1e30, -1e30, 0.5, 1e-30], 0), (2, [-1e-30, 3e7, 0.25, -0.1], 0), (3, [1e30, 3e7, 0.5, 9e3], None)]
    want = brute_codes([x for x in rows])
    long = (1 << 63) - 1
    assert coded(spark, rows) == [(i, c, min(e, long), min(t, long), d) for i, c, e, t, d in want]
    assert coded(spark, []) == [] == coded(spark, [(1, None, 0)])
