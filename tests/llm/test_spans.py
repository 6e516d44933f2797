import random
import re

import numpy as np
import pytest

from lineside.llm import pii, secret_scan
from lineside.llm.spans import digest, masked


def plain_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_plain_patterns_equal_the_expressions():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "1", "22", ".", "@", "-", "+", " ", "(", "255", "4524132264652876", "é"]) for _ in range(25))
        assert sorted(pii.identifiers(text)) == sorted(plain_pii(text)), text


def test_disguises_are_found_at_source_offsets():
    for text, kind, part in [
        ("mail john (at) mail [dot] example.com now", "email", "john (at) mail [dot] example.com"),
        ("x jane dot doe at mail dot example dot com", "email", "jane dot doe at mail dot example dot com"),
        ("call plus one two three four five five five six seven eight nine!", "phone", "plus one two three four five five five six seven eight nine"),
        ("card ４５２４１３２２６４６５２８７６.", "card", "４５２４１３２２６４６５２８７６"),
        ("to аdmin@exаmple.com", "email", "аdmin@exаmple.com"),
    ]:
        base = pii.identifiers(text)
        assert [(k, text[a:b]) for k, a, b in pii.hidden_identifiers(text, base)] == [(kind, part)]
    assert pii.hidden_identifiers("look at the dot of light, one two", []) == []


def test_spoken_forms():
    for text, kind, part in [
        ("write to jane.roe at example.com today", "email", "jane.roe at example.com"),
        ("escribe a jane arroba mail punto example punto com hoy", "email", "jane arroba mail punto example punto com"),
        ("an jane at mail punkt de", "email", "jane at mail punkt de"),
        ("jean at mail point fr", "email", "jean at mail point fr"),
        ("host 192 dot 168 dot 1 dot 20 is up", "ip", "192 dot 168 dot 1 dot 20"),
    ]:
        assert [(k, text[a:b]) for k, a, b in pii.hidden_identifiers(text, [])] == [(kind, part)], text
    assert pii.hidden_identifiers("we met at noon to look at the point of it 3 point 14", []) == []


def test_one_disguised_character_in_an_address():
    for text, kept in [("j\u0430ne.doe@example.com", 2), ("jane@example.c\u043em", 0), ("ja\u200bne@example.com", 3)]:
        base = pii.identifiers(text)
        added = pii.hidden_identifiers(text, base)
        assert base[0][1] == kept and added == [("email", 0, len(text))]
        assert masked(f"{text} x", base + added) == "[EMAIL] x"
    assert pii.hidden_identifiers("\u0430 jane@example.com", pii.identifiers("\u0430 jane@example.com")) == []


def test_pii_rows(documents, odd_rows):
    rows = odd_rows + [(50, "a@b.co and ip 1.2.3.4"), (51, "jo (at) b (dot) co")]
    got = {(r.doc_id, r.spans): r for r in pii.find_pii(documents(rows), mask=True).collect()}
    one, two = got[50, "email:0:6,ip:14:21"], got[51, "email:0:18"]
    assert (one.n_email, one.n_ip, one.n_added, one.masked_text) == (1, 1, 0, "[EMAIL] and ip [IP]")
    assert (two.n_email, two.n_added, two.base_sha256, two.masked_text) == (0, 1, digest([]), "[EMAIL]")
    assert pii.find_pii(documents(rows)).count() == len(rows)
    kept = pii.mask_pii(documents(rows))
    assert kept.columns == documents(rows).columns
    assert {r.text: r.n_chars for r in kept.where("doc_id IN (1, 50)").collect()} == {None: 0, "[EMAIL] and ip [IP]": 19}
    assert pii.find_pii(documents([])).count() == 0


def test_masking_overlaps():
    assert masked("abcdef", [("x", 0, 3), ("y", 2, 5)]) == "[X]f"


def plain_secrets(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    found = [("assign", *m.span()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_plain_secrets_equal_the_expressions():
    rng = random.Random(2)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", " ", "=", ":", "'", '"', "AKIA", "ABCDEFGH1234", "a1b2c3d4e5f6a7b8", "ſecret", "xyz-_=/", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(secret_scan.plain_secrets(text)[0]) == sorted(plain_secrets(text)), text


def secret_text(rng, word, sign):
    value = "".join(rng.choice("0123456789abcdef") for _ in range(24))
    return f"then came the {word}{sign}{value} and more words", value


def test_field_learns_from_plain_matches_and_decodes():
    rng, data = random.Random(4), []
    for i in range(60):
        data += secret_scan.training_sequences(secret_text(rng, rng.choice(["password", "token", "secret"]), rng.choice(["=", ": ", " = "]))[0])
        data += secret_scan.training_sequences(f"call 555-{rng.randint(1000, 9999)} or mail bob.{rng.randint(10, 99)}@mail{i}.example.com now")
    field = secret_scan.fit_field(data)
    assert all(field.viterbi(feats) == tags for feats, tags in data)
    text, value = secret_text(rng, "passphrase", "=")
    assert secret_scan.plain_secrets(text)[0] == []
    assert [text[a:b] for _, a, b in secret_scan.tagged_secrets(text, field, [])] == [value]
    assert secret_scan.tagged_secrets("call 555-1234 or mail bob.77@mail3.example.com now", field, []) == []


def test_viterbi_equals_all_paths():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(3)
    field = secret_scan.Field(rng.normal(size=(secret_scan.BUCKETS, 3)), rng.normal(size=(3, 3)))
    feats = [[1, 2], [], [3], [4, 5], [6]]
    emit, move = field.emissions(feats), field.transitions()
    def score(path):
        return sum(emit[i, s] for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
    assert tuple(field.viterbi(feats)) == max(product(range(3), repeat=5), key=score)


def test_secret_rows(documents, odd_rows):
    rng = random.Random(9)
    rows = odd_rows + [(100 + i, secret_text(rng, "password", "=")[0]) for i in range(30)]
    got = secret_scan.find_secrets(documents(rows)).collect()
    assert len(got) == len(rows) and sum(r.n_assign for r in got) == 30
    assert {r.spans for r in got if r.doc_id == 1} == {""}
    assert secret_scan.find_secrets(documents([])).count() == 0


def test_long_runs_take_linear_time():
    import time

    for text in (" " * 1_000_000 + "[at", "a" + " " * 1_000_000 + "(", "[ " * 500_000, "x at " * 200_000, "(at)" + "\n" * 1_000_000 + "y"):
        began = time.perf_counter()
        assert pii.hidden_identifiers(text, []) == []
        assert time.perf_counter() - began < 5
    text = "".join(f"jane.roe{i}@example.com, " for i in range(20_000)) + "j[at]x.org"
    base = pii.identifiers(text)
    began = time.perf_counter()
    assert [text[a:b] for _, a, b in pii.hidden_identifiers(text, base)] == ["j[at]x.org"]
    assert time.perf_counter() - began < 5


def test_marks_that_follow_each_other():
    text = "write to jane [at] example [dot] com or joe(at)(dot)x or  < at >  y {dot} org"
    tape = pii.Tape(text)
    pii._marks(tape)
    assert tape.text == "write to jane@example.com or joe@.x or@y.org"


def test_secret_stretches_are_those_of_the_whole_text():
    """Features and path of the stretches equal those of one chain over all tokens, however far apart these lie."""
    rng = random.Random(12)
    field = secret_scan.Field(np.random.default_rng(3).normal(size=(secret_scan.BUCKETS, 3)), np.random.default_rng(4).normal(size=(3, 3)))
    words = ["token", "=", ":", "a" * 70, "key", "x1" * 6, "deadbeef99", "b2c3d4e5==", "9", "|", "</b>"]
    texts = ["secret =" + " " * 60 + "k3yk3yk3y", "w" * 60 + " : k3yk3yk3y" + " " * 60 + "end"]
    texts += ["".join(rng.choice(words) + rng.choice(["", " ", "\n", " " * 55]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for text in texts:
        spans = [m.span() for m in secret_scan._TOKEN.finditer(text)]
        may = [b - a >= 8 and any(c in "0123456789" for c in text[a:b]) for a, b in spans]
        feats = secret_scan.token_features(text, spans, may, [])
        path = field.viterbi(feats) if spans else []
        want = [(s, f, t) for s, m, f, t in zip(spans, may, feats, path) if m]
        got = []
        for some, possible in secret_scan.sequences(text):
            part = secret_scan.token_features(text, some, possible, [])
            got += [(s, f, t) for s, m, f, t in zip(some, possible, part, field.viterbi(part)) if m]
        assert got == want, text


def test_every_token_of_the_text_is_scored_and_decoded():
    """Spans are those of one chain over all tokens, whatever these look like, also where many texts are decoded at once."""
    rng = random.Random(8)
    words = ["token", "=", ":", "correcthorse", "key", "x1" * 6, "Straße", "İ", "b2c3==", "9", "|", "</b>", "\u3000", "a.b/c" * 5]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "\n", " " * 30]) for _ in range(rng.choice([0, 1, 3, 30, 90]))) for _ in range(60)]
    texts += ["plain words only, without a digit", " \n ", "".join(rng.choice(words) + " " for _ in range(700))]
    field = secret_scan.Field(np.random.default_rng(5).normal(size=(secret_scan.BUCKETS, 3)), np.random.default_rng(6).normal(size=(3, 3)))
    plain, want = 0, []
    for text in texts:
        spans = [m.span() for m in secret_scan._TOKEN.finditer(text)]
        may = [b - a >= 8 and any(c in "0123456789" for c in text[a:b]) for a, b in spans]
        path = field.viterbi(secret_scan.token_features(text, spans, may, secret_scan.file_features(text))) if spans else []
        found = []
        for (a, b), m, tag in zip(spans, may, path):
            if tag == secret_scan.BEGIN:
                found.append((a, b))
            elif tag == secret_scan.INSIDE:
                found[-1] = (found[-1][0], b)
            plain += tag != secret_scan.OUTSIDE and not m
        assert [s[1:] for s in secret_scan.tagged_secrets(text, field, [])] == found, text
        assert sum(len(some) for some, _ in secret_scan.sequences(text)) == len(spans)
        want.append(found)
    assert plain > 100
    decoder = secret_scan.Decoder(field, most=50)
    assert [decoder.tags(texts[:40]), decoder.tags(texts[40:])] == [want[:40], want[40:]]


def test_a_secret_of_letters_alone_is_learnt_and_found():
    rng, data = random.Random(3), []
    for _ in range(60):
        value = "".join(rng.choice("abcdefghijkmnopqrstuvwxyz") for _ in range(20))
        data += secret_scan.training_sequences(f"then came the {rng.choice(['password', 'token', 'secret'])}={value} and more words")
        data += secret_scan.training_sequences(f"then came the {rng.choice(['letter', 'colour', 'size'])} and more {rng.choice(['words', 'lines'])}")
    field = secret_scan.fit_field(data)
    text = "then came the passphrase=qzkwvxjhpqmnbvtrlksd and more words"
    assert [text[a:b] for _, a, b in secret_scan.tagged_secrets(text, field, [])] == ["qzkwvxjhpqmnbvtrlksd"]


def test_sums_by_blocks_are_those_of_one_token_after_another():
    rng = np.random.default_rng(1)
    size = np.array([1, 2, 64, 65, 200, 3, 128, 129])
    x, move = rng.uniform(0.01, 1, (size.sum(), 3)), rng.uniform(0.1, 2, (3, 3))
    x[np.cumsum(size) - size, 2] = move[0, 2] = 0
    got, o = secret_scan._both_ways(x, size, move), 0
    for n in size:
        fore, aft = [x[o]], [np.ones(3)]
        for t in range(o + 1, o + n):
            fore.append(fore[-1] @ move * x[t])
        for t in range(o + n - 1, o, -1):
            aft.append(move @ (x[t] * aft[-1]))
        for mine, want in zip(got, (fore, aft[::-1])):
            assert mine[o:o + n] / mine[o:o + n].sum(axis=1, keepdims=True) == pytest.approx(np.array([w / w.sum() for w in want]))
        o += n
