from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from tablewright.llm import chunks, text
from tablewright.llm.fm_index import FMIndex, suffix_array
from tablewright.llm.packing import CAPACITY, cut
from tablewright.llm.sharding import schedule


def test_words_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(text, "STEP", 16)
    texts = ["A b  cé_d", None, "", " \t\n", "x" * 100 + " y", "ab", "ab Ab aB"]
    data, at = text.flat(pa.array(texts, pa.string()))
    start, end, h, first = text.words(data, at, text.BETWEEN_SPACES)
    raw = bytes(data)
    got = [[raw[start[k] : end[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    names: dict[int, set[str]] = {}
    for x, y, z in zip(start, end, h, strict=True):
        names.setdefault(int(z), set()).add(raw[x:y].decode().lower())
    assert all(len(x) == 1 for x in names.values()) and len(names) == len(set().union(*names.values()))


def test_blocks_cover_all_rows():
    at = np.array([0, 5, 5, 30, 31])
    assert list(text.blocks(at, 6)) == [(0, 2), (2, 3), (3, 4)]


def test_fm_index_finds_what_a_scan_finds():
    rng = random.Random(3)
    for _ in range(20):
        runs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 40))] for _ in range(8)]
        symbols = np.array([s for r in runs for s in [*r, 0]])
        order = suffix_array(symbols)
        assert sorted(order.tolist()) == list(range(len(symbols)))
        phrases = np.array([[rng.randint(1, 4) for _ in range(3)] for _ in range(10)])
        lengths = np.array([rng.randint(1, 3) for _ in range(10)])
        index = FMIndex(symbols)
        lo, hi = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, lo, hi, strict=True):
            want = [i for i in range(len(symbols) - n + 1) if list(symbols[i : i + n]) == list(p[:n])]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_cuts_do_not_depend_on_what_stands_far_before(monkeypatch):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n)).encode()
    find = lambda raw: chunks.cuts(np.frombuffer(raw, np.uint8), chunks.units(np.frombuffer(raw, np.uint8))[0])
    passage = words(200)
    copies = [passage, words(90) + b" " + passage, b"x\n" + passage + b" " + words(40)]
    at = [len(c) - len(passage) if k < 2 else 2 for k, c in enumerate(copies)]
    ends = [{e - a for e in find(c).tolist() if 0 <= e - a < len(passage)} for c, a in zip(copies, at, strict=True)]
    for other in ends[1:]:
        common = {e for e in ends[0] if e > 100}
        assert len(common) > 8 and common == {e for e in other if e > 100}
    for raw in (b"", b" ", b"one", passage, b"a" * 5000, b"a " * 3000, "é日本".encode() * 900, copies[1]):
        whole = find(raw)
        assert (whole[-1] if len(whole) else 0) == len(raw) and (np.diff(whole, prepend=0) > 0).all()
        assert np.diff(whole, prepend=0).max(initial=0) <= chunks.MOST_CHUNK
    before = find(copies[1]).tolist()
    monkeypatch.setattr(chunks, "STEP", 64)
    assert find(copies[1]).tolist() == before


def test_words_of_scripts_with_and_without_spaces():
    found = lambda t: [t.encode()[a:b].decode() for a, b in zip(*chunks.units(np.frombuffer(t.encode(), np.uint8)), strict=True)]
    assert found("ab é–“x”  c\n") == ["ab", "é–“x”", "c"]
    assert found("a日本b c") == ["a", "日", "本", "b", "c"]
    assert found("x " + "y" * 50) == ["x", *"y" * 50] and found("y" * 49) == ["y" * 49]


def test_pieces_of_every_length_fill_their_class():
    for n in range(1, 3 * CAPACITY):
        pieces = cut(n)
        assert sum(pieces) == n and all(0 < p <= CAPACITY for p in pieces)
        assert len(pieces) <= n // CAPACITY + 4


def test_largest_goes_to_the_least_loaded():
    placed = schedule([(5, 1, 1), (4, 1, 2), (3, 1, 3), (3, 1, 4), (3, 1, 5)], 2)
    assert [placed[1, i] for i in (1, 2, 3, 4, 5)] == [0, 1, 1, 0, 1]


def test_words_made_to_collide_have_hashes_of_their_own():
    """Thue-Morse words and their complements are equal as polynomials modulo 2^64, whatever the base."""
    for size in (256, 257, 1024, 2048, 4096):
        first = "".join("ab"[i.bit_count() % 2] for i in range(size))
        other = first.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer(f"{first} {other} {first.upper()}".encode(), np.uint8)
        _, _, h, _ = text.words(data, np.array([0, len(data)]), text.LETTERS_DIGITS)
        assert h[0] != h[1] and h[0] == h[2]
