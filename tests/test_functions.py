from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import codecs
from tokenloom.functions.text import embedding_text, metadata_json, string_metadata
from tokenloom.functions.vectors import cluster_count, decode_levels, encode_levels, split_ints

pairs = st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=60)


@given(pairs)
@settings(max_examples=200, deadline=None)
def test_pairs_round_trip(values):
    values = np.array(sorted(values), np.uint32).reshape(-1, 2)
    assert (codecs.decode_pairs(codecs.encode_pairs(values)) == values).all()


@given(st.binary(max_size=300))
@settings(max_examples=100, deadline=None)
def test_lz4_round_trip(data):
    assert codecs.lz4_unpack(codecs.lz4_pack(data)) == data


def test_lz4_size_zero_ignores_what_follows():
    assert codecs.lz4_unpack(b"\0\0\0\0rest") == b""
    with pytest.raises(ValueError):
        codecs.lz4_unpack(b"\0")


def test_nibbles_high_first():
    assert codecs.pack_nibbles(np.array([1, 2, 15, 0])) == bytes([0x12, 0xF0])
    assert codecs.unpack_nibbles(bytes([0x12, 0xF0])).tolist() == [1, 2, 15, 0]
    with pytest.raises(ValueError):
        codecs.pack_nibbles(np.array([1]))


def test_halves_and_floats():
    assert codecs.halves_to_floats(np.array([0x3C00, 0xC000, 0x7C00], np.uint16)).tolist() == [1.0, -2.0, float("inf")]
    v = np.array([0.5, -1.25], np.float32)
    assert (codecs.floats_from_blob(codecs.floats_to_blob(v)) == v).all()


def test_splitmix_is_the_published_generator():
    rng = codecs.SplitMix64(1234567)
    assert [rng.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    picked = codecs.SplitMix64(7).sample(100, 20)
    assert len(set(picked)) == 20 and max(picked) < 100


def test_levels_saturate_and_keep_their_place(spark):
    df = spark.createDataFrame([([-9.0, -0.25, 0.0, 0.25, 9.0],)], "v array<double>")
    levels, back = df.select(encode_levels("v"), decode_levels(encode_levels("v"))).first()
    assert levels[0] == levels[1] == 0 and levels[3] == levels[4] == 15
    assert abs(back[0] + 0.25) < 1e-9 and abs(back[4] - 0.25) < 1e-9


def test_residual_error_is_small(spark):
    v = np.random.default_rng(1).normal(0, 0.08, 4000).tolist()
    back = spark.createDataFrame([(v,)], "v array<double>").select(decode_levels(encode_levels("v"))).first()[0]
    assert np.mean((np.array(v) - np.array(back)) ** 2) < 5e-4


def test_embedding_text_rules(spark):
    df = spark.createDataFrame([(None, "b" * 300), ("short", "b" * 300), ("t" * 20, "body"), ("short", "x")], "title string, body string")
    got = [r[0] for r in df.select(embedding_text(F.col("title"), F.col("body"))).collect()]
    assert got == ["b" * 300, "short\n" + "b" * 200 + "\n" + "b" * 300, "t" * 20 + "\nbody", "short\nx\nx"]


def test_metadata_keeps_strings_only(spark):
    df = spark.createDataFrame([('{"k":5,"s":"5","n":null,"o":{"a":1}}',), ("",), ("[1]",), (None,)], "j string")
    assert [r[0] for r in df.select(string_metadata("j")).collect()] == [{"s": "5"}, {}, {}, {}]
    assert df.limit(1).select(metadata_json(F.create_map())).first()[0] == ""


def test_int_lists(spark):
    df = spark.createDataFrame([("",), ("1,2,3",)], "t string")
    assert [r[0] for r in df.select(split_ints("t")).collect()] == [[], [1, 2, 3]]


def test_cluster_count():
    assert cluster_count(10_000, 200) == 50
    assert cluster_count(100, 160) == 160
    assert cluster_count(1, 1) == 1


def test_metadata_keys_may_hold_quotes(spark):
    keys = {"it's": "x", 'say "a"': "y", "a']['b": "z", "$.c": "w", "n": 1}
    df = spark.createDataFrame([(json.dumps(keys),), ("[1]",), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(string_metadata("j")).collect()] == [{k: v for k, v in keys.items() if v != 1}, {}, {}, {}]
