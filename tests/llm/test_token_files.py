from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from probewise.llm import packing, store, tokens
from probewise.llm.queries import tokenizer_spec

SPEC = tokenizer_spec()
WHOLE = Tokenizer.from_str(SPEC)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_encoder_equals_the_library(texts):
    enc = tokens.encoder(SPEC)
    ids, starts = enc.encode(pa.array(texts, pa.large_string()), 7)
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*ids_of(t), 7]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = f.read()
    enc = tokens.Encoder(spec)
    assert not enc.by_word
    texts = ["a b  c", "", "x\n y"]
    ids, starts = enc.encode(pa.array(texts, pa.large_string()), 3)
    plain = Tokenizer.from_str(spec)
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 3]


def test_files_round_trip(spark, edge_docs):
    out = store.folder(spark, "t")
    manifest = tokens.write_token_files(edge_docs, out, SPEC, 1, shards=3)
    got = [tuple(r) for r in tokens.read_token_files(spark, out, manifest).collect()]
    rows = [(r.doc_id, [*ids_of(r.text), 1]) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(d), len(i), crc(i)) for d, i in rows)
    got.sort(key=lambda g: g[1])
    assert [g[0] for g in got] == [r[0] for r in in_order([(d, i) for d, i in rows])]
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    flat = np.concatenate([store.read_array(f"{out}/{m['name']}.ids", m["dtype"]) for m in manifest])
    assert len(flat) == sum(len(i) for _, i in rows) and flat.dtype == np.dtype("<u2")


def test_no_documents(spark, empty_docs):
    out = store.folder(spark, "t")
    manifest = tokens.write_token_files(empty_docs, out, SPEC, 1)
    assert manifest == [] and tokens.read_token_files(spark, out, manifest).count() == 0
    assert packing.pack(empty_docs, SPEC, 2).count() == 0


def brute_cost(at, cost, length):
    best = [0.0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= length:
                options.append(best[i] + (0 if n & (n - 1) == 0 else length - n))
        best.append(min(options) + cost[j])
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 1.0, 3.0])), min_size=1, max_size=40))
def test_cuts_cost_least(steps):
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    cost = np.array([0.0] + [c for _, c in steps])
    cuts = packing.choose_cuts(at, cost, 16)
    own = sum((0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + cost[np.searchsorted(at, b)] for a, b in zip(cuts, cuts[1:], strict=False))
    assert cuts[0] == 0 and cuts[-1] == at[-1] and abs(own - brute_cost(at, cost, 16)) < 1e-9


def test_packing_keeps_every_id_once(spark, edge_docs):
    rows = packing.pack(edge_docs, SPEC, 2, length=64, shards=3, keep_ids=True).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream = []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            stream.append(r)
        assert at <= 64
    docs, now, name = [], [], None
    for r in stream:
        now += np.frombuffer(r.ids, "<u4").tolist()
        assert r.start + r.length <= r.doc_tokens
        if r.start + r.length == r.doc_tokens:
            docs.append((r.doc_id, tuple(now)))
            now = []
    wanted = [(r.doc_id, (*ids_of(r.text), 2)) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted(docs, key=str) == sorted(wanted, key=str)
    assert [d[0] for d in docs] == [d[0] for d in in_order(wanted)]
