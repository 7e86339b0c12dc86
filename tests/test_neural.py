from __future__ import annotations

import struct

import numpy as np
import pytest

from tokenloom.functions import kernels as K
from tokenloom.operators.embed import InputTooLarge, NeuralEmbedder
from tokenloom.operators.tokenizer import Unigram
from tokenloom.sources.gguf import GGUF


def pack_block(rng):
    """A random super-block and its values, taken bit by bit."""
    d, dmin = np.float16(0.013), np.float16(0.007)
    scales, mins = rng.integers(0, 64, 8), rng.integers(0, 64, 8)
    q = rng.integers(0, 16, 256)
    s = bytearray(12)
    for j in range(4):
        s[j] = scales[j] | (scales[j + 4] >> 4) << 6
        s[j + 4] = mins[j] | (mins[j + 4] >> 4) << 6
        s[j + 8] = (scales[j + 4] & 15) | (mins[j + 4] & 15) << 4
    low = bytearray()
    for pair in range(4):
        for i in range(32):
            low.append(q[pair * 64 + i] | q[pair * 64 + 32 + i] << 4)
    want = [float(d) * scales[i // 32] * q[i] - float(dmin) * mins[i // 32] for i in range(256)]
    return struct.pack("<ee", d, dmin) + bytes(s) + bytes(low), want


def test_blocks_expand():
    a, x = pack_block(np.random.default_rng(1))
    b, y = pack_block(np.random.default_rng(2))
    assert np.allclose(K.q4k_expand(a + b, 512), x + y, atol=1e-5)
    with pytest.raises(ValueError):
        K.q4k_expand(a, 512)


def test_kernels():
    x = np.random.default_rng(0).standard_normal((3, 8)).astype(np.float32)
    assert np.allclose((K.rms_norm(x, np.ones(8), 0) ** 2).mean(1), 1, atol=1e-5)
    assert np.allclose(K.softmax(x).sum(1), 1) and np.allclose(K.softmax(x, -1e9 * (np.arange(8) > 2))[:, 3:], 0)
    assert np.allclose(K.row_norms(K.l2_norm(x)), 1, atol=1e-6) and not K.l2_norm(np.zeros((1, 4))).any()
    assert abs(K.gelu(np.array([1.0]))[0] - 0.841192) < 1e-5
    assert (K.gather(x, np.array([2, -1, 9]))[1:] == 0).all()
    b = K.position_buckets(200)
    assert b[0, 0] == 0 and b[3, 0] == 3 and b[0, 3] == 19 and b[0, 199] == 31 and b[199, 0] == 15


def tiny():
    rng = np.random.default_rng(4)
    w = lambda *s: rng.standard_normal(s).astype(np.float32) * 0.3
    layer = K.Layer(np.ones(8, np.float32), w(8, 8), w(8, 8), w(8, 8), w(8, 8), np.ones(8, np.float32), w(16, 8), w(16, 8), w(8, 16))
    return K.Encoder(w(12, 8), [layer], w(32, 2), np.ones(8, np.float32), w(4, 8) * 5, 2)


def test_padding_changes_nothing():
    e = tiny()
    a = e.raw(np.array([1, 2, 3]))
    b = e.raw(np.array([1, 2, 3, 0, 0]), [1, 1, 1, 0, 0])
    assert np.allclose(a, b[:3], atol=1e-5)


def write_gguf(path, tensors, metadata):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    out = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(metadata))
    for k, v in metadata.items():
        out += text(k) + (struct.pack("<I", 8) + text(v) if isinstance(v, str) else struct.pack("<II", 4, v) if isinstance(v, int) else struct.pack("<IIQ", 9, 6, len(v)) + struct.pack(f"<{len(v)}f", *v))
    body = b""
    for name, (x, kind) in tensors.items():
        body += b"\0" * (-len(body) % 32)
        out += text(name) + struct.pack("<I", x.ndim) + b"".join(struct.pack("<Q", n) for n in x.shape[::-1]) + struct.pack("<IQ", kind, len(body))
        body += x.astype("<f4" if kind == 0 else "<f2").tobytes()
    path.write_bytes(out + b"\0" * (-len(out) % 32) + body)


def test_model_file_and_embedder(spark, tmp_path):
    e = tiny()
    layer = e.layers[0]
    names = {"attn_norm": layer.attention_norm, "attn_q": layer.q, "attn_k": layer.k, "attn_v": layer.v, "attn_o": layer.o, "ffn_norm": layer.feed_norm, "ffn_gate": layer.gate, "ffn_up": layer.up, "ffn_down": layer.down, "attn_rel_b": e.position}
    tensors = {f"enc.blk.0.{k}.weight": (v, 0) for k, v in names.items()} | {"token_embd.weight": (e.embedding, 0), "enc.output_norm.weight": (e.final_norm, 0), "projection.weight": (e.projection, 1)}
    write_gguf(tmp_path / "m.gguf", tensors, {"general.name": "tiny", "t5.attention.head_count": 2, "scores": [1.0, 2.0]})
    g = GGUF(tmp_path / "m.gguf")
    assert g.metadata["general.name"] == "tiny" and g.metadata["scores"] == [1.0, 2.0]
    read = g.encoder()
    g.close()
    assert np.allclose(read.raw(np.array([1, 5])), e.raw(np.array([1, 5])), atol=0.02)
    t = Unigram([("<unk>", 0.0), *((f"▁{c}", -1.0) for c in "abcdefghij")], unk=0)
    m = NeuralEmbedder(e, t, window=4, stride=2, least_norm=0.0)
    assert m.starts(9) == [0, 2, 4, 5] and m.starts(3) == [0]
    v = m.encode("a b c d e f g")
    assert v.shape == (7, 4) and np.allclose(K.row_norms(v), 1, atol=1e-5)
    assert m.encode("  ").shape == (0, 4) and m.encode_query("a b", 1).shape == (0, 4)
    with pytest.raises(InputTooLarge):
        NeuralEmbedder(e, t, window=4, overflow="reject").encode("a " * 40)
    (tmp_path / "bad").write_bytes(b"nope")
    with pytest.raises(ValueError):
        GGUF(tmp_path / "bad")
