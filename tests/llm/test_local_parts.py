"""Parts that need no Spark."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from claimlens.llm import ann, frames, licenses, media, packing, site_style, toxicity, units
from claimlens.llm.queries import tokenizer_path


def test_pack_round_trip():
    a = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int64), np.arange(12, dtype=np.uint8).reshape(3, 4), np.arange(6, dtype=np.int32)]
    for x, y in zip(a, frames.unpack(frames.pack(*a, raw=(2,))), strict=True):
        assert x.dtype == y.dtype and x.shape == y.shape and (x == y).all()


def test_words():
    texts = ["", "a", " a  b\n", "é\x0bü x", "a\xa0b"]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    s, e, at = units.words(np.frombuffer(raw, np.uint8), offsets)
    got = [[raw[s[k] : e[k]].decode() for k in range(at[i], at[i + 1])] for i in range(len(texts))]
    assert got == [[], ["a"], ["a", "b"], ["é", "ü", "x"], ["a\xa0b"]]


def test_anchors_depend_on_the_window_only():
    r = random.Random(4)
    common = [r.randrange(1, 1 << 40) for _ in range(60)]
    found = []
    for before in (0, 7, 31):
        v = np.array([r.randrange(1 << 40) for _ in range(before)] + common + [5, 6, 7], np.uint64)
        pos, h, first, last = units.anchors(v, np.array([len(v)]), 6, 20)
        windows = {}
        for p, a, b in zip(pos, first, last, strict=True):
            for s in range(a, b + 1):
                windows[s] = p - s
        assert sorted(windows) == list(range(len(v) - 19))
        found.append([windows[before + s] for s in range(41)])
    assert found[0] == found[1] == found[2]


def test_hilbert_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.argsort(ann.hilbert(grid, bits))
        assert sorted(ann.hilbert(grid, bits)) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_lengths():
    assert packing.lengths(1) == [1]
    assert packing.lengths(2 * 2048 + 5) == [2048, 2048, 4, 1]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no vocabulary files")
def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    texts = ["", "Hello  world\n\n x", "né  über,\tx\xa0 y", "a" * 300, "日本語 テキスト。x", "it's <|endoftext|> here", " \n ", "x\x1cy z\x85 w", "1 23  ４５ k"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts = packing._parts(raw, offsets)
    flat, counts = packing._Ids(tokenizer_path()).look_up(raw, starts, np.append(starts[1:], len(raw)))
    total = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]
    for i, t in enumerate(texts):
        assert flat[total[i] : total[i + 1]].tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_media_round_trip():
    for text in (b"", b"x", bytes(range(256)) * 9, b"y" * 576):
        data = media.payload(text)
        assert len(data) % 576 == 0 and data.startswith(text) and set(data[len(text) :]) <= {255}
        image = media.encode(data)
        assert media.decode(image) == data and media.header(image[: media.HEADER])["width"] == 576
    broken = bytearray(image)
    broken[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(broken))


def test_license_sentences_hold_keywords():
    for s in licenses.SENTENCES.values():
        assert any(k in s for k in licenses.KEYWORDS), s


def test_html_blocks():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class="sidebar"><p>x</p></div>
    <article><header><h1>T &lt;1&gt;</h1></header><p>One<br>two  <b>bold<p>Three &amp;amp; <i>it</i> <a href="x>y">lin</a>k.</p><!-- no -->
    <div class=comments><p>c</p></div><form>f</form><script>var a = "</p>";</script><ul><li>a<li>b</ul></article><footer>f</footer><p>out <scr"""
    assert site_style.blocks(site_style.parse(page)) == ["T <1>", "One two bold", "Three &amp; it link.", "a", "b"]
    assert site_style.blocks(site_style.parse("")) == []
    assert site_style.blocks(site_style.parse("a < b <p>c")) == ["a < b", "c"]
    assert site_style.blocks(site_style.parse("<div>" * 5000 + "deep")) == ["deep"]


def test_toxicity_separates():
    r = random.Random(2)
    prose = [f"w{i}o" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = [r.choice(prose) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["nastyword", "horridterm", "vileslur"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:500], labels[:500])

    def score(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        text, cuts, _ = toxicity.spaced(raw, np.array([0, len(raw)]))
        return model.score(model.features(text, cuts))

    right = sum((score(t) >= 0.5) == bool(y) for t, y in zip(texts[500:], labels[500:], strict=True))
    assert right >= 85
    assert 0 <= score("") < 0.5
    assert 0 <= toxicity.fit([], []).score([0.0] * toxicity.FEATURES) <= 1
