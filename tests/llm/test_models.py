"""Learned operators: exact parts against brute force, the rest on held-out rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from messy import docs
from pyspark.sql import functions as F

from gradus.llm import langid, lmscore, pii
from gradus.llm.common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


class Backoff:
    """The automaton's probabilities from dictionaries, arc by arc."""

    def __init__(self, texts):
        seqs = [tokens(t) for t in texts]
        self.one = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.one.values()), len(self.one)
        n1, n2 = (sum(c == i for c in self.one.values()) for i in (1, 2))
        self.d = min(0.95, max(0.1, n1 / (n1 + 2 * n2)))
        self.state = {w for w, c in self.one.items() if c >= 2}
        two = Counter(p for s in seqs for p in zip(s, s[1:]) if self.state >= set(p))
        self.two = {p: c for p, c in two.items() if c >= 2}
        three = Counter(p for s in seqs for p in zip(s, s[1:], s[2:]) if p[:2] in self.two and p[1:] in self.two)
        self.three = {p: c for p, c in three.items() if c >= 2}
        self.left2, self.left3 = Counter(), Counter()
        for p, c in self.two.items():
            self.left2[p[0]] += (c - 0.75) / self.one[p[0]]
        for p, c in self.three.items():
            self.left3[p[:2]] += (c - 0.75) / self.two[p[:2]]

    def p1(self, w):
        return max(self.one[w] - self.d, 0) / self.n + self.d * self.v / self.n / (self.v + 1)

    def p2(self, a, w):
        own = (self.two[a, w] - 0.75) / self.one[a] if (a, w) in self.two else 0
        return own + (1 - self.left2[a]) * self.p1(w) if a in self.state else self.p1(w)

    def p3(self, a, b, w):
        own = (self.three[a, b, w] - 0.75) / self.two[a, b] if (a, b, w) in self.three else 0
        return own + (1 - self.left3[a, b]) * self._below(b, w)

    def _below(self, b, w):
        return self.p2(b, w)

    def score(self, text):
        s, out = tokens(text), []
        for i, w in enumerate(s):
            if i >= 2 and (s[i - 2], s[i - 1]) in self.two:
                seen = (s[i - 2], s[i - 1], w) in self.three
                p = self.p3(*s[i - 2 : i + 1]) if seen else (1 - self.left3[s[i - 2], s[i - 1]]) * self._arc(s[i - 1], w)
            else:
                p = self._arc(s[i - 1], w) if i else self.p1(w)
            out.append(np.log10(p))
        return math.fsum(out)

    def _arc(self, a, w):
        if (a, w) in self.two:
            return self.p2(a, w)
        return (1 - self.left2[a]) * self.p1(w) if a in self.state else self.p1(w)


def test_lm_scores(spark):
    d = docs(spark)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    train = [t for i, t in rows if i is not None and i % 7]
    model = Backoff(train)
    got = lmscore.scores(d, F.col("doc_id") % 7 != 0).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        s = tokens(t)
        base = sum(np.log10((model.one[w] + 1) / (model.n + model.v + 1)) for w in s)
        want[i, len(s), sum(model.one[w] > 0 for w in s), model.n, round(base, 4), round(model.score(t), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    assert {r.score for r in lmscore.scores(d, F.lit(False)).collect()} == {0.0}
    assert lmscore.scores(d.limit(0), F.lit(True)).count() == 0


def test_lm_keeps_rare_ngrams(spark, monkeypatch):
    """n-grams that occur twice among millions of tokens are arcs, in tasks or in the join."""
    rows = [(1, "x " * 3_300_000), (2, "rare one two three x"), (3, "rare one two three y"), (4, "z rare one two"), (5, None), (None, "two three y new")]
    model = Backoff([t for i, t in rows if i])
    want = {i: model.score(t) for i, t in rows}
    assert ("rare", "one", "two") in model.three
    for hot in (1 << 20, 2, 0):
        monkeypatch.setattr(lmscore, "HOT", hot)
        monkeypatch.setattr(lmscore, "HOT_GRAMS", hot)
        got = lmscore.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id").isNotNull()).collect()
        assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) <= 1e-9 * abs(want[r.doc_id]) for r in got), hot


@pytest.mark.parametrize("bits, parts, ranges", [(26, 2, 1_000_000), (5, 16, 1_000_000), (26, 4, 20), (12, 16, 5)])
def test_lm_with_full_filters(spark, monkeypatch, bits, parts, ranges):
    """Without room for a filter, and with more ranges than parts, all n-grams are looked for: the same scores."""
    for name, value in (("BITS", bits), ("PARTS", parts), ("RANGE", ranges), ("HOT", 4), ("HOT_GRAMS", 4)):
        monkeypatch.setattr(lmscore, name, value)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("a", "b", "c", "d", f"w{rng.randrange(30)}", f"one{i}-{rng.random()}")) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    model = Backoff([t for i, t in rows if i % 3])
    got = lmscore.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") % 3 != 0).collect()
    assert len(got) == len(rows)
    for r in got:
        want = model.score(rows[r.doc_id][1])
        assert abs(r.score - want) <= 1e-9 * abs(want)


def test_lm_mass():
    """After any history the probabilities of all words and of one unseen word sum to one."""
    m = Backoff(["a b a b c", "a b c a b", "b a b c c", "d"])
    words = [*m.one, "unseen"]
    for a in words:
        assert abs(sum(m._arc(a, w) for w in words) - 1) < 1e-9


def test_lm_beats_base(spark):
    d = table(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    s = lmscore.scores(d, ~held).join(d.where(held).select("doc_id"), "doc_id").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert s.s > s.b


def test_language_held_out(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.train(d.where(~held))
    found = langid.predict(d.where(held), model).join(d.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right, n, rejected = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if("rejected")).first()
    assert right / n > 0.95, (right, n)
    assert rejected / n < 0.03, (rejected, n)


def test_language_cases(spark):
    d = docs(spark)
    model = langid.train(d)
    got = langid.predict(d, model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    text = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    for r in got:
        if r.doc_id is not None and r.doc_id != 9:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")), r
    none = langid.predict(d, langid.train(d.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.predict(d.limit(0), model).count() == 0


def test_language_letters(spark):
    """Number characters are no letters; marks belong to their word, in training as in prediction."""
    assert langid.split("½ ² 12 ③") == [] and langid.split("हिन्दी Éa-b") == ["हिन्दी", "éa", "b"]
    rows = [(i, "हिन्दी भाषा में लिखा", "hi") for i in range(40)] + [(i, "words of plain english", "en") for i in range(40, 80)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    big = (1 << 60) + 1
    d = spark.createDataFrame([(big, "हिन्दी में", "x"), (None, "½ ²", "x"), (3, "plain words", "x")], "doc_id bigint, text string, rejected string").coalesce(1)
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, model).collect()}
    assert got == {big: "hi", None: "und", 3: "en"}
    kept = langid.judged(d, model)
    assert kept.columns == ["doc_id", "text", "lang_pred", "score", "cost", "n_symbols", "rejected"] and kept.count() == 3


def test_language_rejects_others(spark):
    """Texts of a language that is not learned are rejected, by the pooled limit if a language has
    few calibration texts."""
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(d.where("lang in ('en', 'de')"))
    odd = "zxqj vkkw qqpz xjvk zzqx kwvj pqqz xxkv jwzq vvxk qzpj kkxw zjqv " * 20
    got = langid.predict(spark.createDataFrame([(1, odd)], "doc_id bigint, text string"), model).first()
    assert got.rejected
    few = langid.train(d.where("lang = 'en'").unionByName(d.where("lang = 'de'").limit(9)))
    assert np.isfinite(few.mean).all()


class KneserNey:
    """Interpolated Kneser-Ney by dictionaries, over words with their begin and end marks."""

    def __init__(self, words, alphabet):
        self.alphabet, n = alphabet, langid.ORDER
        top = Counter()
        for w, c in words.items():
            s = "^" * (n - 1) + w + "$"
            for i in range(n - 1, len(s)):
                top[s[i - n + 1 : i + 1]] += c
        self.counts = {n: top}
        for k in range(n - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d = {}
        for k, c in self.counts.items():
            n1, n2 = (sum(v == i for v in c.values()) for i in (1, 2))
            self.d[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5

    def p(self, context, char, k):
        c, d = self.counts[k], self.d[k]
        if k == 1:
            total = sum(c.values())
            return max(c[char] - d, 0) / total + d * len(c) / total / self.alphabet
        context = context[len(context) - k + 1 :]
        mine = {g: v for g, v in c.items() if g[:-1] == context}
        if not mine:
            return self.p(context, char, k - 1)
        total = sum(mine.values())
        return max(mine.get(context + char, 0) - d, 0) / total + d * len(mine) / total * self.p(context, char, k - 1)


def test_kneser_ney_against_dictionaries():
    words = {"ab": 3, "abc": 1, "b": 2, "ca": 1, "abcab": 2}
    alphabet = 5  # a b c, the end, and one for all others
    orders = langid._fit_language(list(words), np.array(list(words.values())), alphabet)
    pairs = [[(k, p)] for k, p, _, _ in orders]
    keys, probs = zip(*(langid._merge(x, np.nan) for x in pairs))
    contexts, weights = zip(*(langid._merge([(c, g)], 0.0) for _, _, c, g in orders[1:]))
    model = langid.Model(["x"], list(keys), list(probs), list(contexts), list(weights), -30.0, *(np.zeros(1) for _ in range(3)))
    brute = KneserNey(words, alphabet)
    for w in ("ab", "ba", "cab", "abcab", "c"):
        s = "^" * (langid.ORDER - 1) + w + "$"
        want = -sum(np.log2(brute.p(s[:i], s[i], langid.ORDER)) for i in range(langid.ORDER - 1, len(s)))
        assert abs(langid.word_costs(model, [w])[0, 0] - want) < 1e-4, w
    for context in ("^^^^", "^^^a", "^^ab", "zzzz"):
        seen = sum(brute.p(context, c, langid.ORDER) for c in "abc$")
        assert seen < 1 < seen + 2 * brute.p(context, "?", langid.ORDER) + 1e-9


def brute_pii(text):
    out = []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_pii(spark):
    d = docs(spark).union(docs(spark, [(1000, "a@b@c.de x@y.z.w@q.rs +1(743)555-38241 1.2.3.4.5.6.7.8 300.1.1.1.1"), (1001, "9" * 5000 + " 4012888888881881 5500-0000-0000-0004"), (1002, "@ @a a@ a@.b a@b.c@d.e")])).union(
        table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("x")] * (len(docs(spark).columns) - 5))
    )
    names = ("email", "ip", "card", "phone")
    want = Counter()
    texts = Counter()
    for r in d.select("doc_id", "text").collect():
        s = brute_pii(r.text or "")
        joined = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in s)
        want[r.doc_id, *(sum(k == i for k, _, _ in s) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest()] += 1
        texts[r.doc_id, joined] += 1
    got = pii.detect(d).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    base = {}
    for (i, joined), _ in texts.items():
        base.setdefault(i, []).append(set(filter(None, joined.split(","))))
    assert all(any(b <= set(r.spans.split(",")) for b in base[r.doc_id]) for r in got)
    assert pii.detect(d.limit(0)).count() == 0


def test_base_patterns_against_plain_ones():
    """The same matches as the patterns on random strings, and long dense texts in seconds."""
    import time

    rng = random.Random(9)
    plain = lambda t: [(0, *m.span()) for m in pii.EMAIL.finditer(t)] + [(1, *m.span()) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for _ in range(20000):
        t = "".join(rng.choice("a1@..-_% 259+é\n") for _ in range(rng.randrange(0, 40)))
        assert [x for x in pii.base_spans(t) if x[0] < 2] == plain(t), t
    for piece in ("7", "a", "a@", "1.", "1.1", "a.b@c.d_", "+1 ", "+1(", "@", "4111 ", "x@y"):
        for t in (piece * 300_000, piece * 300_000 + "@x", "y" * 1_000_000 + piece * 1000):
            start = time.perf_counter()
            pii.base_spans(t)
            assert time.perf_counter() - start < 5, piece


def test_viterbi_is_best():
    import itertools

    rng = np.random.default_rng(0)
    f = pii.Field({}, np.zeros((0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    e = rng.normal(size=(5, 4, 3))
    for row, path in zip(e, pii.viterbi(f, e)):
        value = lambda p: f.start[p[0]] + sum(row[i][p[i]] for i in range(4)) + sum(f.move[p[i], p[i + 1]] for i in range(3))  # noqa: E731, B023
        assert max(itertools.product(range(3), repeat=4), key=value) == tuple(path)


def test_field_on_held_out_rows():
    """Spans of rows that the field has not seen: precision and recall of the decoded spans, and of
    what the base patterns alone find; so the field is what finds the rest."""
    field = pii.fit()
    rows = pii.made(2, 80)
    right = found = wanted = base_right = 0
    for words, y in rows:
        text, at, true = " ".join(words), 0, set()
        for i, w in enumerate(words):
            if y[i] % 2 == 1:
                j = i
                while j + 1 < len(words) and y[j + 1] == y[i] + 1:
                    j += 1
                true.add(((y[i] - 1) // 2, at, at + len(" ".join(words[i : j + 1]))))
            at += len(w) + 1
        (base, every), = pii.find([text], field)
        right += len(true & set(every))
        base_right += len(true & set(base))
        found += len(every)
        wanted += len(true)
    print(f"field: precision {right / found:.3f}, recall {right / wanted:.3f}, base recall {base_right / wanted:.3f}")
    assert right / found > 0.9 and right / wanted > 0.9
    assert right > base_right + 0.1 * wanted
