"""Sentences by place, marks on them, six levels of agreement and rules against people, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adsentry.functions import redact as R
from adsentry.operators import annotation as A
from adsentry.operators import sentences as Z

TEXTS = ["Hallo Welt. Das ist ein Satz! „Und noch einer“? Ja.\n\n  Neue Zeile, z. B. hier.\r\nEnde", "", None, "   ", "ohne Punkt", "Am 3. Mai geht es los. 𝒳 Ähm… Was? Ok", "a\ue000b. C", "Wort. " * 300]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "task int, text string")


def test_sentences_have_places(spark, texts):
    own = {r.task: r.s for r in texts.select("task", R.sentences(F.translate("text", "\ue000", " ")).alias("s")).collect()}
    got = defaultdict(list)
    for r in Z.sentence_table(texts).orderBy("task", "nr").collect():
        assert r.nr == len(got[r.task])
        assert TEXTS[r.task].replace("\ue000", " ")[r.start : r.stop] == r.sentence
        got[r.task].append(r.sentence)
    assert all(got[i] == (own[i] or []) for i in own)
    assert len(got[7]) == 300


def rated(spark, texts):
    rng = random.Random(6)
    sentences = Z.sentence_table(texts)
    places = defaultdict(list)
    for r in sentences.collect():
        places[r.task].append((r.nr, r.start, r.stop))
    ratings, marks, images = [], [], []
    for task in range(8):
        for person in rng.sample(range(4), rng.randrange(5)):
            ratings.append((task, person, rng.choice(["betrug", "serioes", "unklar"]), rng.choice(["a", "b", None])))
            for _ in range(rng.randrange(4)):
                start = rng.randrange(0, len(TEXTS[task] or "") + 5)
                marks.append((task, person, start, start + rng.choice([0, 1, 5, 40, 700]), rng.choice(["zeit", "link"])))
            images += [(task, person, i, rng.choice(["k1", "k2", None]), rng.choice(["ja", "nein"])) for i in range(rng.randrange(3))]
    return sentences, places, ratings, marks, images


def plain_marked(places, marks):
    best = {}
    for task, person, start, stop, signal in marks:
        for nr, a, b in places[task]:
            if start < stop and a < stop and start < b:
                key = (task, person, nr)
                best[key] = min(best.get(key, (start, signal)), (start, signal))
    return {k: v[1] for k, v in best.items()}


def test_marks_levels_and_rules(spark, texts):
    sentences, places, ratings, marks, images = rated(spark, texts)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    r = frame(ratings, "task int, person int, verdict string, scheme string")
    marked = Z.marked_sentences(sentences, frame(marks, "task int, person int, start int, stop int, signal string"))
    want = plain_marked(places, marks)
    assert {(x.task, x.person, x.nr): x.signal for x in marked.collect()} == want

    people = defaultdict(list)
    for task, person, *_ in ratings:
        people[task].append(person)
    units = defaultdict(lambda: defaultdict(list))
    for task, _, verdict, scheme in ratings:
        if verdict != "unklar":
            units["verdict"][task].append(verdict)
        if verdict == "betrug" and scheme:
            units["scheme"][task].append(scheme)
    for task, who in people.items():
        for nr, *_ in places[task] if len(who) > 1 else ():
            for p in who:
                signal = want.get((task, p, nr), "keins")
                units["sentence_kind"][task, nr].append(signal)
                units["sentence_flag"][task, nr].append(signal != "keins")
    for task, _, image, kind, flag in images:
        if len(people[task]) > 1:
            units["image_flag"][task, image].append(flag)
            if kind:
                units["image_kind"][task, image].append(kind)

    def alpha(level):
        shared = [v for v in units[level].values() if len(v) > 1]
        n = sum(map(len, shared))
        counts = Counter(x for v in shared for x in v)
        apart = sum(sum(a != b for a in v for b in v) / (len(v) - 1) for v in shared)
        expected = n * n - sum(c * c for c in counts.values())
        return 1 - (n - 1) * apart / expected if n > 1 and expected else None

    votes = Z.level_votes(r, sentences, marked, frame(images, "task int, person int, image int, kind string, flag string"))
    got = {x.level: (x.alpha, x.shared) for x in A.krippendorff(votes, ["level"]).collect()}
    assert set(got) == set(units) and len(got) == 6
    for level, (a, shared) in got.items():
        assert shared == sum(len(v) > 1 for v in units[level].values())
        assert a == pytest.approx(alpha(level), abs=1e-9)

    human = {}
    for task, who in people.items():
        for nr, *_ in places[task]:
            given = Counter(want[task, p, nr] for p in who if (task, p, nr) in want)
            if 2 * sum(given.values()) > len(who):
                human[task, nr] = min(given, key=lambda s: (-given[s], s))
    found = Z.consensus_sentences(r, marked)
    assert {(x.task, x.nr): x.signal for x in found.collect()} == human

    rules = F.array_compact(F.array(F.when(F.contains("sentence", F.lit("Wort")), "zeit"), F.when(F.contains("sentence", F.lit("Satz")), "link"), F.when(F.contains("sentence", F.lit("a")), "fremd")))
    counts, examples = Z.rules_against_people(sentences, found, rules, ["zeit", "link", "nie"])
    tally, missed, false = defaultdict(Counter), [], []
    for x in sorted(sentences.collect()):
        own = {s for w, s in (("Wort", "zeit"), ("Satz", "link"), ("a", "fremd")) if w in x.sentence}
        given = human.get((x.task, x.nr))
        tally["*"]["tp" if own and given else "fp" if own else "fn" if given else "tn"] += 1
        for s in ("zeit", "link"):
            if s in own or s == given:
                tally[s]["tp" if s in own and s == given else "fp" if s in own else "fn"] += 1
        if given and not own:
            missed.append(("missed", x.task, x.nr, given))
        if own and not given:
            false.append(("false alarm", x.task, x.nr, ", ".join(sorted(own))))
    got = {x.signal: x for x in counts.collect()}
    assert {s: (x.tp, x.fp, x.fn) for s, x in got.items()} == {s: (c["tp"], c["fp"], c["fn"]) for s, c in tally.items()}
    for x in got.values():
        assert x.precision == (pytest.approx(x.tp / (x.tp + x.fp)) if x.tp + x.fp else None)
    assert sorted((x.kind, x.task, x.nr, x.signal) for x in examples.collect()) == sorted(missed[:15] + false[:15])
    assert len(false) > 15
