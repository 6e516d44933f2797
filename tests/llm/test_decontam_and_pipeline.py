import random
from collections import Counter, defaultdict

import corpus_pipeline
import regex
from pyspark.sql import functions as F

from lineside.llm import decontam
from tests.llm.conftest import prose
from tests.llm.test_duplicates import expected_components
from tests.llm.test_tokens_and_packing import check_sequences

ITEM = "If John has 12 apples and gives 5 km of rope to Mary then how many apples does John have left today"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_templates(spark, documents, odd_rows):
    rows = odd_rows + [
        (50, f"Intro. {ITEM}. End"),
        (51, "Intro. " + ITEM.replace("John", "Peter").replace("Mary", "Anna").replace("12", "3,000").replace("5", "7")),
        (52, "Intro. " + ITEM.replace("John", "Peter", 1)),
        (53, "Intro. " + " ".join(ITEM.split()[:10]) + " something else altogether follows here and goes on"),
        (54, "short item of five words")]
    marks = items(spark, [(1, ITEM), (2, None), (3, "too short"), (4, "short item of five words"), (5, ""), (1, ITEM)])
    got = {r.doc_id: r for r in decontam.contaminated(documents(rows), marks).collect()}
    assert set(got) == {50, 51, 52, 54}
    assert not got[52].reworded and got[52].cover < 1
    assert (got[50].item_ids, got[50].reworded, got[51].reworded) == ([1], False, True)
    assert got[50].cover > 0.8 and got[54].item_ids == [4]
    assert decontam.contaminated(documents([]), marks).count() == 0
    assert decontam.contaminated(documents(rows), items(spark, [])).count() == 0


def test_an_odd_number_drops_its_windows_only(spark, documents):
    text = "the shop sold 5 red apples and then it also sold 3 green pears to a man who paid 5 euros and went home at noon without any of them"
    rows = [(1, text.replace("5", "4").replace("3", "4")), (2, text.replace("5 euros", "9 euros")), (3, text.replace("5 red", "7 red")),
            (4, "a shop sold many other things")]
    got = {r.doc_id: r for r in decontam.contaminated(documents(rows), items(spark, [(1, text)])).collect()}
    assert set(got) == {1, 2, 3} and got[1].cover == 1 and got[2].cover < 1


def test_sentence_starts_are_names_and_short_items_are_met_exactly(spark, documents):
    tom = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have?"
    marks = items(spark, [(1, tom), (2, "Compute 12 + 7 * 3 - 4."), (3, "What is 12 + 34?")])
    rows = [(1, "So. " + tom.replace("Tom", "Ann")), (2, "Now: Compute 12 + 7 * 3 - 4. Go on"), (3, "Well, what is 12 + 34? I ask"),
            (4, "Compute 12 + 7 * 3 - 5. What is 12 + 35?")]
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(documents(rows), marks).collect()}
    assert got == {1: [1], 2: [2], 3: [3]}


def test_the_shuffled_join_gives_the_same(spark, documents, monkeypatch):
    docs, marks = documents([(1, ITEM), (2, "nothing of the kind is said in this text"), (1, ITEM)]), items(spark, [(1, ITEM)])
    one = decontam.contaminated(docs, marks).collect()
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert decontam.contaminated(docs, marks).collect() == one and len(one) == 1


def words_of(text):
    """(kind, value) of each token: n a number, u a unit, N a name, H a name or the start of a sentence, w another word."""
    found, end = [], None
    for m in regex.finditer(r"[0-9]+(?:[.,][0-9]+)*|\p{L}+", text or ""):
        word, at = m.group(), m.start()
        if word[0].isdigit():
            kind = "n"
        elif end is not None and regex.fullmatch(r"\s?", text[end:at]) and word in decontam.UNITS:
            kind = "u"
        elif word[0].isupper():
            kind = "N" if at > 1 and regex.fullmatch(r"[^.!?\s]\s", text[at - 2:at]) else "H"
        else:
            kind = "w"
        end = m.end() if kind == "n" else None
        found.append((kind, word.lower()))
    return found


def held_items(text, marks, window=8, least_cover=0.5):
    """item -> (cover, other values): every window of the item against every window of the text."""
    doc, out = words_of(text), {}
    for item, item_text in marks:
        own = words_of(item_text)
        size = min(len(own), window)
        slots = lambda words: [("N" if k == "H" else k, "" if k != "w" else v) for k, v in words]
        pairs, count = defaultdict(list), [set(), set()]
        for i in range(len(own) - size + 1 if size else 0):
            ours = own[i:i + size]
            exact = size < 5 or sum(k == "w" for k, _ in ours) < size / 2
            count[exact].add(i)
            for j in range(len(doc) - size + 1):
                theirs = doc[j:j + size]
                if [v for _, v in ours] == [v for _, v in theirs] if exact else slots(ours) == slots(theirs):
                    pairs[j - i].append((i, exact, [] if exact else [(a, b, i + n) for n, (a, b) in enumerate(zip(ours, theirs)) if a[0] != "w"]))
        good, changed = [set(), set()], False
        for windows in pairs.values():
            images, sure = defaultdict(Counter), defaultdict(set)
            for a, b, at in {s for w in windows for s in w[2]}:
                images[slots([a])[0][0], a[1]][b[1]] += 1
                if a[0] == "N":
                    sure[a[1]].add(b[1])
            # Of values that are as frequent, the item's own is the usual one, then the greatest.
            usual = {a: max(seen, key=lambda v: (seen[v], v == a[1], v)) for a, seen in images.items()}
            split = any(len(v) > 1 for v in sure.values())
            for i, exact, at in windows:
                same = all(a[1] == b[1] for a, b, _ in at)
                if same or not split and all(usual[slots([a])[0][0], a[1]] == b[1] for a, b, _ in at):
                    good[exact].add(i)
                    changed = changed or not same
        cover = max(len(good[0]) / len(count[0]) if count[0] else 0, len(good[0] | good[1]) / (len(count[0]) + len(count[1])) if size else 0)
        if cover >= least_cover:
            out[item] = (cover, changed)
    return out


def test_against_every_window(spark, documents):
    rng = random.Random(10)
    names, stock = ["John", "Mary", "Ann", "Peter"], "the shop sold red apples to a man who then paid for all of them at noon and went home".split()

    def sentence():
        made = [rng.choice([rng.choice(stock), rng.choice(stock), rng.choice(stock), rng.choice(names), str(rng.randrange(2, 40)),
                            f"{rng.randrange(2, 9)} {rng.choice(['km', 'kg', 'hours'])}"]) for _ in range(rng.randrange(3, 22))]
        return " ".join(made) + rng.choice([".", "?", "!", ","])

    marks = [(i, " ".join(sentence() for _ in range(rng.randrange(1, 3)))) for i in range(30)] + [(30, "7 + 5"), (31, ITEM)]
    rows = [(900, None), (901, "")]
    for d in range(120):
        held = rng.choice(marks)[1].split(" ")
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(held))
            held[at] = rng.choice(names) if held[at] in names else str(rng.randrange(2, 40)) if held[at].isdigit() else rng.choice(stock) if d % 3 == 0 else held[at]
        if d % 5 == 0:
            old, new = rng.sample(names, 2)
            held = [new if w == old else w for w in held]
        rows.append((d, " ".join([sentence(), *held, sentence()])))
    got = {r.doc_id: r for r in decontam.contaminated(documents(rows), items(spark, marks)).collect()}
    expected = {d: found for d, text in rows if (found := held_items(text, marks))}
    assert {d: r.item_ids for d, r in got.items()} == {d: sorted(found) for d, found in expected.items()}
    for d, found in expected.items():
        assert abs(got[d].cover - max(c for c, _ in found.values())) < 1e-12 and got[d].reworded == any(x for _, x in found.values())
    assert len(expected) > 80 and {r.reworded for r in got.values()} == {True, False}


def test_no_python_in_the_plan(spark, documents, capsys):
    decontam.contaminated(documents([(1, ITEM)]), items(spark, [(1, ITEM)])).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Pandas", "Arrow"))


def test_the_stage_takes_pairs_from_80_percent(spark, documents):
    rng, rows = random.Random(80), []
    for g in range(40):
        words = prose(rng, 200).split()
        rows.append((2 * g, " ".join(words)))
        changed = list(words)
        for at in rng.sample(range(5, len(words) - 5), 1 + g % 8):
            changed[at] = f"other{at}"
        rows.append((2 * g + 1, " ".join(changed)))
    docs = documents(rows)
    comp, strict = expected_components(rows, 80), expected_components(rows)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {d for d, c in comp.items() if d == c}
    assert 40 < len(kept) < len({d for d, c in strict.items() if d == c})


def test_pipeline(spark, tmp_path):
    rng, rows, labels = random.Random(8), [], []
    for i in range(160):
        text = prose(rng, 60, 300)
        if i % 8 == 0:
            text += " utter scumlord"
        if i % 8 == 1 and i > 8:
            text = rows[i - 8][1] if i % 16 == 9 else rows[i - 1][1].replace(" utter scumlord", "") + " tail"
        if i % 8 == 2:
            text += " " + ITEM
        if i % 8 == 3:
            text += f" write to user{i}@mail.example.com now"
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, 1, int("scumlord" in text)))
    rows += [(500, None, None, None, None), (501, "", "en", "src", 0), rows[5], rows[5]]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items(spark, [(1, ITEM)]).write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {r[0] for r in rows if r[1] and "scumlord" in r[1]}
    left = [r for r in rows if r[0] not in toxic]
    assert sorted(r.doc_id for r in seen["toxicity"]) == sorted(r[0] for r in left)
    comp = expected_components([r[:2] for r in left])
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted({r[0] for r in left if comp[r[0]] == r[0]})
    assert {r.doc_id for r in seen["decontamination"]} == {r.doc_id for r in seen["near_dedup"] if ITEM not in (r.text or "")}
    assert len(seen["pii"]) == len(seen["decontamination"]) and not any("@" in (r.text or "") for r in seen["pii"])
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["pii"]}
    check_sequences(seen["packing"], 2048, 0.6)
    ran = corpus_pipeline.run(spark, folder)
    assert ran.agg(F.sum("length")).first()[0] == sum(r.length for r in seen["packing"])
