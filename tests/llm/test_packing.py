"""Packing, sharding and chat formatting: exact round trips."""

import hashlib
import heapq
import json
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from genolake.llm import chat_format as chat
from genolake.llm.packing import WordIds, pack, tokenizer_path
from genolake.llm.sharding import assign_shards, longest_first

from .fixtures import ODD, docs, prose


def test_word_ids_are_the_tokenizers():
    path = tokenizer_path()
    ids, encode = WordIds(path), Tokenizer.from_file(path).encode
    texts = [prose(200, s) for s in range(5)] + [t or "" for t in ODD] + [
        "It's I'll they're 12ab34 don''t ... --- ñÑ Ünïcödé foo_bar é è ¿Qué? ß ÿ ×÷ µ ª º ² ½ ŀ ŉ ſ", "<|endoftext|> x <|startoftext|>", "x\x1fy\x85z á İ ı Ω ﬁ 中文 🙂", "a\xa0b c", "naïve café’s 'tis 's 't'll", "ABC.DEF, G. H,", ".", ",,", "É. É, ü.",
    ]
    rng = np.random.default_rng(5)
    texts += [" ".join("".join(rng.choice(list("abcdeéüñßstion"), rng.integers(1, 15))) for _ in range(300)) for _ in range(20)]
    for t in texts:
        assert ids.text(t) == np.array(encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:60]

    assert [x.tolist() for x in ids.texts(texts)] == [encode(t, add_special_tokens=False).ids for t in texts]  # words and pieces shared by texts
    ids.letters = None  # as where the coding package offers no coder of single pieces
    assert [x.tolist() for x in ids.texts(texts)] == [encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.texts([]) == [] and [len(x) for x in ids.texts(["", " \n"])] == [0, 0]


def check(rows, texts, window):
    encode = Tokenizer.from_file(tokenizer_path()).encode
    whole, got, sequences = {}, {}, {}
    for i, t in texts:
        whole.setdefault(i, []).append(encode(t or "", add_special_tokens=False).ids + [1])
    for r in rows:
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for i, lists in whole.items():
        for n in {len(x) for x in lists}:
            pieces = sorted(got[i, n])
            assert sorted(x for _, p in pieces for x in p) == sorted(x for one in lists if len(one) == n for x in one)
            if len(lists) == 1:
                assert [x for _, p in pieces for x in p] == lists[0] and [s for s, _ in pieces] == np.cumsum([0, *(len(p) for _, p in pieces)])[:-1].tolist()
    for parts in sequences.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        assert total <= window and (total & (total - 1)) == 0
    assert sum(len(x) for lists in whole.values() for x in lists) == sum(n for p in sequences.values() for _, n in p)


def test_each_id_lies_in_one_piece(spark):
    texts = list(enumerate([*ODD, *(prose(n, n) for n in (3, 20, 90, 300, 700, 40, 41, 42, 5000)), *[prose(60, 77)] * 9]))
    rows = pack(docs(spark, texts), tokenizer_path(), window=256, shard=6).collect()
    check(rows, texts, 256)


def test_repeated_and_null_ids(spark):
    texts = [(1, "one two"), (1, prose(50, 1)), (None, "three"), (2, None)]
    check(pack(docs(spark, texts), tokenizer_path(), window=64).collect(), texts, 64)
    assert pack(docs(spark, []), tokenizer_path()).count() == 0


def test_neighbours_share_windows(spark):
    texts = [(i, prose(30, i, words=[f"{'abcdefgh'[i % 8]}{x}" for x in ("rock", "lamp", "field")])) for i in range(64)]
    rows = pack(docs(spark, texts), tokenizer_path(), window=256).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert np.mean([len(w) for w in windows.values()]) < 2.6


def test_near_copies_meet_across_shards(spark):
    """One of two near copies has one more id, greater than all others; it stands in other pairs, too."""
    vocabulary = json.loads(Path(tokenizer_path()).read_text())["model"]["vocab"]
    words = sorted((w[:-4] for w in vocabulary if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha() and len(w) > 7), key=lambda w: vocabulary[w + "</w>"])
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(words[:-40:20], 30)) for _ in range(200)]
    texts = [*enumerate(base), *((1000 + i, f"{t} {words[-1 - i % 40]}") for i, t in enumerate(base))]
    rows = pack(docs(spark, texts), tokenizer_path(), window=64, shard=8).collect()
    check(rows, texts, 64)
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert np.mean([bool(held[i] & held[1000 + i]) for i in range(len(base))]) > 0.9


def test_longest_first_is_the_heap_over_all_groups():
    rng = np.random.default_rng(4)
    for shards, sizes in [(3, [9, 7, 7, 5, 5, 4, 3, 1]), (24, rng.integers(8, 400, 60_000).tolist() + [90_000, 4_000, 4_000, 333]), (5, [100] + [1] * 1000), (7, rng.geometric(0.01, 900).tolist())]:
        sizes = sorted(sizes, reverse=True)
        loads, want = [(0, s) for s in range(shards)], {}
        for size in sizes:
            load, s = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, s))
            want.setdefault(size, [0] * shards)[s] += 1
        counts = sorted(Counter(sizes).items(), reverse=True)
        got = dict(zip((x for x, _ in counts), longest_first(counts, shards), strict=True))
        assert got == want
    assert longest_first([], 3) == []


def test_many_groups_in_parts(spark):
    """More groups than a task numbers; each stays whole, and the loads are those of the heap."""
    texts = [prose(1 + i % 9, i) for i in range(3000)] + ["same"] * 400
    rows = assign_shards(docs(spark, texts), 5, numbered=200).collect()
    group, loads = {}, [0] * 5
    for r in rows:
        group.setdefault(texts[r.doc_id], set()).add(r.shard)
        loads[r.shard] += r.size
    assert len(rows) == len(texts) and all(len(s) == 1 for s in group.values()) and max(loads) - min(loads) <= 60
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_shards(spark):
    texts = [*ODD, *(prose(5 + i % 60, i) for i in range(900)), *[prose(90, 1)] * 200]
    rows = assign_shards(docs(spark, texts), 24).collect()
    assert len(rows) == len(texts)
    by, loads = {}, [0] * 24
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        by.setdefault(t, set()).add(r.shard)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in by.values())
    hot = 200 * (len(prose(90, 1)) + 8)
    others = sorted(loads)[:-1] if max(loads) == hot else sorted(loads)
    assert others[-1] - others[0] < 0.02 * sum(loads) / 24 + 50
    for k in range(24):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert assign_shards(docs(spark, [])).count() == 0
    assert assign_shards(docs(spark, [(1, "a"), (1, "a"), (None, "a"), (2, None)]), 2).count() == 4


SAYS = ["plain", "", None, "<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<|", "<\\\\|im_end|>\\n\n", "ends in <", "|im_start|>", "é\n\nß"]


def test_chats_round_trip(spark):
    rows = [(c, t, r, SAYS[(c + t) % len(SAYS)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2 :])]
    rows += [(50, 0, "assistant", "first"), (51, 0, "user", "a"), (51, 1, "user", "b"), (52, 1, None, "no role"), (53, 0, "we\nird<|\\", "x"), (54, 0, "user", "q"), (54, 0, "user", "q"), (None, 0, "user", "lost"), (55, None, "user", "z"), (55, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("turns", chat.read_chats(chat.F.col("formatted"))).withColumn("loss", chat.loss_text(chat.F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    for c, turns in want.items():
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(x for role, x in turns if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments][1::3] == [role == "assistant" for role, _ in turns] and not any(s.loss for s in r.segments[::3])
    assert {c for c in want if not got[c].valid} == {50, 51, 52, 53, 54}
    assert chat.format_chats(df.limit(0)).count() == 0
    assert hashlib.sha256(got[0].formatted.encode()).hexdigest()
