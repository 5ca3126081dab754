import math
import random
import re

from pyspark.sql import functions as F

from meltframe.llm import toxicity as T

CLEAN = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re", "tu") for b in ("ran", "sol", "tek", "vim") for c in ("", "a", "os", "ent")]
RUDE = ["blighter", "scallywag", "nitwitted"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("idiom", False), ("stem", True), ("wörter", False)]
    matcher, rng = T.Matcher(terms), random.Random(3)

    def brute(token):
        found = [edits(token, t) for t, stem in terms if not stem and edits(token, t) <= T.errors_allowed(t, False)]
        found += [0 for t, stem in terms if stem and token.startswith(t)]
        return min(found, default=None)

    words = [t for t, _ in terms]
    for _ in range(4_000):
        token = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(token) + 1)
            token[at:at + rng.randrange(2)] = rng.choice(["", "x", "i", "s", "ö"])
        token = "".join(token)
        assert matcher.match(token) == brute(token), token
    assert matcher.match("") is None and T.Matcher([]).match("word") is None


def test_quotation_is_told_from_abuse():
    reader = T.Reader([("blighter", False)], report=["said"], address=["you"])
    plain, quoted = 0, 2
    abuse = reader.features("you are a blighter and a bl1ghter")
    assert abuse[plain] > 0 and abuse[1] > 0 and abuse[quoted] == 0 and abuse[4] > 0
    for text in ('he said "you blighter" to them', "the word “blighter” is old", "they wrote: 'a blighter indeed'.", "called «blighter» once", 'so "blighter", they say'):
        x = reader.features(text)
        assert x[quoted] > 0 and x[plain] == 0 == x[5], text
    for text in ("don't be a blighter, don't", 'a 6" blighter', '"quoted" blighter "again"', "it's the blighter's"):
        assert reader.features(text)[quoted] == 0, text
    assert reader.features("")[:7] == [0.0] * 7


def rows(rng, n, start=0):
    docs, labels = [], []
    for i in range(start, start + n):
        words = rng.choices(CLEAN, k=rng.randrange(5, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) if i % 8 else "grumbly" + rng.choice(["sch", "ton", "ka", "lu"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    return docs, labels


LABELS = "doc_id long, toxic int, text int"


def test_held_out_rows_and_misspellings(docs_of, spark):
    docs, labels = rows(random.Random(1), 600)
    labels += [(None, 1, 1), (5, None, 1), (10**6, 1, 1), (4, 0, 1), (4, 1, 1)]
    table = docs_of(docs).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9)).withColumn("term", F.lit(1))
    model = T.train(table, spark.createDataFrame(labels, LABELS))
    assert {t for t, stem in model.terms if not stem} == set(RUDE)
    assert [t for t, stem in model.terms if stem] and all("grumbly".startswith(t) for t, stem in model.terms if stem)
    got = {r["doc_id"]: r["score"] for r in T.score(table, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(600))
    odd = docs_of([(1, None), (2, ""), (3, "karan blihgter scal1ywag rensol"), (None, "blighter! scallywag."), (4, "miran " * 30_000), (4, "miran " * 30_000),
                   (5, "karan " * 20_000 + "nitwitted blighter scallywag")])
    scores = [(r["doc_id"], r["score"]) for r in T.score(odd, model).collect()]
    high = {i for i, s in scores if s >= 0.5}
    assert len(scores) == 7 and {3, None} <= high and not {1, 2, 4} & high and all(0 <= s <= 1 for _, s in scores)
    again = T.train(table.repartition(7), spark.createDataFrame(labels, LABELS))
    assert again.terms == model.terms and all(abs(a - b) < 1e-6 for a, b in zip(again.weights, model.weights))


def test_held_out_labels_are_not_read(docs_of, spark):
    docs, labels = rows(random.Random(2), 300)
    held = {r["doc_id"] for r in spark.range(300).where(~T.in_training(F.col("id"))).select(F.col("id").alias("doc_id")).collect()}
    assert 30 < len(held) < 90
    turned = [(i, 1 - t if i in held else t, x) for i, t, x in labels]
    table = docs_of(docs)
    one, two = [T.train(table, spark.createDataFrame(x, LABELS)) for x in (labels, turned)]
    assert one == two


def test_without_labels_of_both_kinds(docs_of, spark):
    docs = docs_of([(1, "a b c"), (2, None)])
    for labels, want in (([], 0.0), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)):
        model = T.train(docs, spark.createDataFrame(labels, LABELS))
        assert {r["score"] for r in T.score(docs, model).collect()} == {want} or T.in_training is None
    assert T.score(docs_of([]), T.Model()).count() == 0


def test_context_words_are_learned_and_decide(docs_of, spark):
    """The same term, unquoted, at everybody or told of: only the words around it differ."""
    rng, docs, labels = random.Random(4), [], []
    for i in range(800):
        words = rng.choices(CLEAN, k=30)
        kind = i % 4  # 0 abuse, 1 report of it, others clean
        if kind == 0:
            words[10:10] = [rng.choice(["yonder", "thither"]), rng.choice(CLEAN), rng.choice(RUDE), rng.choice(RUDE)]
        elif i % 2:
            words.append(rng.choice(["yonder", "thither"]))
        if i % 40 == 1:
            words[10:10] = ["reportedly", rng.choice(CLEAN), rng.choice(RUDE)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind == 0), 1))
    docs, labels = docs_of(docs), spark.createDataFrame(labels, LABELS)
    model = T.train(docs, labels)
    assert {t for t, _ in model.terms} == set(RUDE)
    assert "reportedly" in model.report and {"yonder", "thither"} <= set(model.address)
    rest = " karan" * 24
    told = {r["doc_id"]: r["score"] for r in T.score(docs_of([(1, "karan reportedly loran blighter" + rest), (2, "karan yonder loran blighter" + rest)]),
                                                     model).collect()}
    assert told[1] < 0.5 <= told[2]


def test_lexicon_and_scores_equal_brute_force(docs_of, spark):
    docs, labels = rows(random.Random(6), 400)
    table = docs_of(docs)
    model = T.train(table, spark.createDataFrame(labels, LABELS))
    held = {r["doc_id"] for r in spark.range(400).where(~T.in_training(F.col("id"))).select(F.col("id").alias("doc_id")).collect()}

    toxic = {i: t for i, t, _ in labels if i not in held}
    n_a, n_b = sum(toxic.values()), len(toxic) - sum(toxic.values())
    a, b, places = {}, {}, {}
    for i, text in docs:
        if i not in toxic:
            continue
        words = [w for w in re.split(r"[^a-z]+", text.lower()) if len(w) >= 3]
        forms = [[w, *[w[:n] + "*" for n in T.STEMS if len(w) >= n]] for w in words]
        for form in {f for fs in forms for f in fs}:
            (a if toxic[i] else b)[form] = (a if toxic[i] else b).get(form, 0) + 1
        if toxic[i]:
            for before, fs in zip(["", *words], forms):
                for form in fs:
                    places.setdefault(form, set()).add(before)
    candidates = {f: n for f, n in a.items() if n >= T.MIN_TOXIC}
    least, strong = 2 * math.log(len(candidates)), {}
    for form, n in candidates.items():
        other = b.get(form, 0)
        if not other / n_b < 0.1 * n / n_a:
            continue
        n = min(n, len(places[form]))
        rate = (n + other) / (n_a + n_b)
        g = 2 * sum(x * math.log(x / m) for x, m in ((n, n_a * rate), (n_a - n, n_a * (1 - rate)), (other, n_b * rate), (n_b - other, n_b * (1 - rate))) if x)
        if n / n_a > other / n_b and g >= least and other / n_b < 0.1 * n / n_a:
            strong[form] = (g, n)
    assert sorted(T.choose_terms(strong)) == sorted(model.terms) and model.terms

    def closest(token):
        token = re.sub(r"^\W+|\W+$", "", token)
        found = [0 for t, stem in model.terms if stem and token.startswith(t)]
        found += [edits(token, t) for t, stem in model.terms if not stem and edits(token, t) <= T.errors_allowed(t, False)]
        return min(found, default=None)

    def brute(text):
        tokens = text.lower().split()
        hits = [(i, e) for i, e in enumerate(map(closest, tokens)) if e is not None]
        free = [(i, e) for i, e in hits if not T.Reader.quoted(tokens, i)]
        near = [{re.sub(r"^\W+|\W+$", "", t) for t in tokens[max(0, i - T.WINDOW):i + T.WINDOW + 1]} for i, _ in hits]
        dense = max((sum(i <= j <= i + 2 * T.WINDOW for j, _ in free) for i, _ in free), default=0)
        share = [sum(bool(w & set(words)) for w in near) / max(1, len(hits)) for words in (model.report, model.address)]
        logs = [math.log1p(sum(e == 0 for _, e in free)), math.log1p(sum(e > 0 for _, e in free)), math.log1p(len(hits) - len(free))]
        x = [1.0, *logs, *share, math.log1p(dense), 100 * len(free) / (len(tokens) + 20) if hits else 0.0, math.log1p(len(tokens))]
        return 1 / (1 + math.exp(-sum(p * q for p, q in zip(model.weights, x))))

    odd = [(1000, 'a "blighter" and (scalywag) blihgter'), (1001, None), (1002, "grumblyx " * 9 + "karan " * 500 + "nitwited!")]
    got = {r["doc_id"]: r["score"] for r in T.score(docs_of(docs[:80] + odd), model).collect()}
    assert len(got) == 83 and all(abs(got[i] - brute(text or "")) < 1e-9 for i, text in docs[:80] + odd)
