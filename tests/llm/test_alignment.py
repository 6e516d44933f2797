import bisect
import hashlib
import random
import sys
from collections import Counter, defaultdict

import pytest

from lineside.llm import alignment

PIECES = list("abXYéÉß 中本'’\"!?.,0123٣½ \t\n\r\x0b\x1c\x85\xa0​᠎▁한🙂ﬁ́") + [
    "<|endoftext|>", "<s>", "</s>", "<0x0A>", "'s", " don't", " the", " word", "\nNext", "  ", "\n\n"]


def brute(rows):
    """Whole texts through the libraries, all links in full, counts over all documents."""
    pair = alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    made = []
    for doc, text in rows:
        groups, links = [], Counter()
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            want = (" " + text).encode()
            if b"".join(pair.bytes_a[i] for i in a) == want == b"".join(pair.bytes_b[i] for i in b):
                at, ends = 0, []
                for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
                    at, own = 0, []
                    for i in ids:
                        at += len(table[i])
                        own.append(at)
                    ends.append(own)
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    p, q = (bisect.bisect_left(x, end) + 1 for x in ends)
                    groups.append((a[i:p], b[j:q]))
                    links.update((x, y) for x in a[i:p] for y in b[j:q])
                    i, j = p, q
        made.append((doc, groups, links))
    count = Counter(k for _, _, links in made for k in links)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for doc, groups, links in made:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(n for k, n in links.items() if count[k] == most[k[0]]), sum(n * count[k] for k, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return out


def mixed_rows():
    rng = random.Random(5)
    return [(100 + i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for i in range(500)]


def found(frame):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in frame.collect()]


@pytest.mark.parametrize("head", [0, 40, 300_000])
def test_equals_whole_texts_through_the_libraries(documents, odd_rows, head):
    rows = odd_rows + mixed_rows()
    got = found(alignment.align(documents(rows).repartition(3), head=head, keep_groups=True))
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_units_and_stretches_leave_the_text_whole():
    rng = random.Random(6)
    pair = alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    for _ in range(600):
        text = " " + "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))).replace("\u2581", "x")
        parts = alignment.units(text)
        assert "".join(map(alignment.whole, parts)) == text
        assert [i for u in parts for i in pair.ids(alignment.whole(u))[0]] == pair.ids(text)[0]
        assert [i for u in parts for i in pair.ids(alignment.whole(u))[1]] == pair.ids(text)[1]


def test_every_code_point_beside_plain_words():
    pair = alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    points = [c for c in [*range(1, 0x3000), *range(0x3000, 0x110000, 7)] if not 0xD800 <= c < 0xE000 and c != 0x2581]
    for at in range(0, len(points), 500):
        text = " " + "".join(f"ab{chr(c)}c {chr(c)} x{chr(c)}\nd" for c in points[at:at + 500])
        parts = alignment.units(text)
        assert [i for u in parts for i in pair.ids(alignment.whole(u))[0]] == pair.ids(text)[0]
        assert [i for u in parts for i in pair.ids(alignment.whole(u))[1]] == pair.ids(text)[1]


def test_long_texts_are_read_in_stretches(documents, monkeypatch):
    rows = [(1, " ".join(f"word{i} a" for i in range(3000))), (2, "x" * 5000), (3, "中" * 3000), (4, " \n" * 2000)]
    whole = brute(rows)
    monkeypatch.setattr(alignment, "STRETCH", 64)
    pair = alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    known = alignment.Units(pair, most=50)
    for (_, text), want in zip(rows, whole):
        measure = alignment.Measure(True)
        for stretch in alignment.stretches(" " + text):
            if known.full():
                known.forget()
            parts = alignment.units(stretch)
            known.learn({u: None for u in parts if u not in known.at})
            measure.add(known, parts)
        row = measure.row()
        assert row[:4] == want[1:5] and row[4] == want[7]


def test_nothing(documents):
    assert alignment.align(documents([])).count() == 0
    rows = alignment.align(documents([(1, None), (None, ""), (2, "▁")])).collect()
    assert all(r.n_a == r.n_b == r.n_links == r.count_sum == 0 and r.groups_sha256 == "" for r in rows) and len(rows) == 3


def learnt(pair, wanted):
    known = alignment.Units(pair)
    known.learn(wanted)
    measure = alignment.Measure(True)
    measure.add(known, wanted)
    return known, measure.row()


def test_units_cost_few_python_steps():
    pair = alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    rng = random.Random(7)
    wanted = sorted({"".join(rng.choice("abcdefghikléöñ") for _ in range(rng.randint(3, 16))) + rng.choice(["", ".", "!!"]) for _ in range(4000)})
    steps = 0

    def step(frame, event, arg):
        nonlocal steps
        steps += event in ("call", "c_call")

    sys.setprofile(step)
    try:
        known = alignment.Units(pair)
        known.learn(dict.fromkeys(wanted))
    finally:
        sys.setprofile(None)
    assert len(known.at) == len(wanted) and known.sizes[:, 2].sum() > 4 * len(wanted)
    assert steps < 10 * len(wanted)  # each group of each unit took several


def test_crowded_groups_are_multiplied_out(monkeypatch):
    pair = alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    rng = random.Random(8)
    wanted = sorted({"".join(rng.choice("abé中🙂𝔘한XX") for _ in range(rng.randint(1, 30))) for _ in range(700)})
    monkeypatch.setattr(alignment, "CROWD", 1)
    _, all_crowded = learnt(pair, wanted)
    monkeypatch.setattr(alignment, "CROWD", 1 << 30)
    _, none_crowded = learnt(pair, wanted)
    assert all_crowded == none_crowded and all_crowded[3] > len(wanted)


def test_a_unit_whose_bytes_do_not_come_back_spoils_no_other():
    pair = alignment.pair_of("byte_bpe_50k.json", "piece_bpe_32k.model")
    good = [f"wörd{i}" for i in range(30)]
    known, _ = learnt(pair, [*good[:10], "a▁b", *good[10:]])
    assert known.sizes[:, 4].tolist() == [0] * 10 + [1] + [0] * 20
    alone, row = learnt(pair, good)
    measure = alignment.Measure(True)
    measure.add(known, good)
    assert measure.row() == row and alone.chars == known.chars - 3
