"""The language of documents and of their paragraphs, whatever their labels say.

Two levels: linear classifiers tell the family (Germanic, Romance, Japonic), then
one-versus-one linear support vector machines tell the related languages of a family
apart. A text's score is the sum of its words' scores, so a word is scored once and kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = {"germanic": ("en", "de"), "romance": ("fr", "es", "it", "pt"), "japonic": ("ja",)}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
# Other names for the languages in labels.
NAMES = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "inglese", "inglês", "英語"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "フランス語"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "スペイン語"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "ドイツ語"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch", "イタリア語"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugais", "ポルトガル語"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語", "japonais", "japanisch"),
}
BITS = 16
PER_LABEL = 300  # most documents of one label that training looks at; a documented bound
SHORT = 3.0  # a text of n words has its confidence damped by (n / (n + SHORT)) squared
LEAST = 0.5  # confidence under which a text counts as in none of the languages
OTHER = "other"

_PAIRS = [(a, b) for f in FAMILIES.values() for a, b in combinations(f, 2)]
_MODELS = [("family", f) for f in FAMILIES] + _PAIRS
_LETTERS = "A-Za-zÀ-ÖØ-öø-\u024f"
_WORD = re.compile(rf"[{_LETTERS}]+(?:['’][{_LETTERS}]+)*")
_FOREIGN = re.compile(rf"[^\W\d_{_LETTERS}\u3040-\u30ff\u3400-\u9fff\uff66-\uff9f々〆ーａ-ｚＡ-Ｚ]")
_KANA = re.compile("[\u3040-\u30ff]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]+")
_MARKUP = re.compile(
    r"<!--.*?-->|```.*?(?:```|\Z)|`[^`\n]*`|<(?:pre|code|math|nowiki|ref|script|style)\b[^>]*>.*?</\w+>|</?[A-Za-z][^<>\n]*>|\{\|[^\n]*|\{\{[^{}]*\}\}|^[!|][^\n]*|https?://\S+|&#?\w+;"
    r"|\[\[(?:Category|File|Image|Kategorie)[^\]]*\]\]|\[\[[^\[\]|]*\||\\[A-Za-z]+\*?(?:\{(?:document|itemize|enumerate)\})?|\$\$.*?\$\$|\\\(.*?\\\)|\$[^$\n]*[\\^_=][^$\n]*\$|^---\n(?:.*\n)*?---$",
    re.S | re.M,
)
_SUSPECT = re.compile(r"[<{`\\$&|]|\[\[|https?:|^---|^!", re.M)
_BLANK = re.compile(r"\n[^\S\n]*\n")


def label_language(label: Column) -> Column:
    """The language a label names (regional and full names included), else null."""
    bare = F.lower(F.trim(F.regexp_replace(label, r"[-_ (].*$", "")))
    table = F.create_map(*(F.lit(x) for k, names in NAMES.items() for n in names for x in (n, k)))
    return F.try_element_at(table, F.coalesce(bare, F.lit("")))


def words_of(text: str) -> list[str]:
    """Words that tell a language: the first word, lower-case words (so that names are
    left out), pairs of Japanese letters."""
    if _SUSPECT.search(text):
        text = _MARKUP.sub(" ", text)
    words = _WORD.findall(text)
    out = [w for w in words if w[0] > "Z"] if text.isascii() else [w for w in words if w[0].islower()]
    if words and words[0][0].isupper():
        out.append(words[0].lower())
    runs = () if text.isascii() else _CJK.findall(text)
    for run in runs:
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return out


def is_foreign(text: str) -> bool:
    """Is most of it in letters that none of the languages is written in? Chinese
    characters without any kana among them count as such."""
    if text.isascii():
        return False
    strange, cjk = len(_FOREIGN.findall(text)), sum(map(len, _CJK.findall(text)))
    if cjk >= 8 and not _KANA.search(text):
        strange += cjk
    return 2 * strange > sum(map(len, _WORD.findall(text))) + strange + (cjk if _KANA.search(text) else 0)


def hashed(word: str) -> list[int]:
    """The word and its letter groups of two to four, with word ends."""
    w = f"^{word}$"
    grams = [w + "="] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    mask = (1 << BITS) - 1
    return [zlib.crc32(g.encode()) & mask for g in grams]


class Model:
    """Weights by classifier; the scores of words met are kept in a table."""

    ROWS = 200_000

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.table = np.zeros((self.ROWS, len(_MODELS)), dtype=np.float32)
        self.rows: dict[str, int] = {}

    def row(self, w: str) -> int:
        """The word's row, scored when it is new."""
        n = len(self.rows)
        if n == self.ROWS:
            self.rows.clear()
            n = 0
        x = hashed(w)
        self.table[n] = self.weights[:, x].sum(axis=1) / np.sqrt(len(x))
        self.rows[w] = n
        return n

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Mean scores of the words of every text, a row each; 0 for a text without words."""
        out, sizes = np.zeros((len(texts), len(_MODELS))), [len(t) for t in texts]
        get, step, k = self.rows.get, self.ROWS // 2, 0
        while k < len(texts):  # as many texts at a time as surely fit in the table
            stop, n = k, 0
            while stop < len(texts) and (n == 0 or n + sizes[stop] <= step):
                n += sizes[stop]
                stop += 1
            for a in range(0, n, step) if stop == k + 1 else (0,):
                words = texts[k][a : a + step] if stop == k + 1 else [w for t in texts[k:stop] for w in t]
                if len(self.rows) + len(words) > self.ROWS:
                    self.rows.clear()
                at = [r if (r := get(w)) is not None else self.row(w) for w in words]
                if not at:
                    continue
                if stop == k + 1:
                    out[k] += self.table[at].sum(axis=0)
                else:
                    full = [i for i in range(k, stop) if sizes[i]]
                    ends = np.cumsum([0] + [sizes[i] for i in full[:-1]])
                    out[full] = np.add.reduceat(self.table[at], ends, axis=0)
            k = stop
        return out / np.maximum(np.array(sizes, dtype=float), 1)[:, None]

    def languages(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """(language, confidence in 0 to 1) of every text, given by its words: the family
        first, then votes of its pairs. A text without words has confidence 0."""
        if not texts:
            return []
        s, sizes = self.scores(texts), np.array([len(t) for t in texts], dtype=float)
        f = len(FAMILIES)
        family, ranked = s[:, :f].argmax(axis=1), np.sort(s[:, :f], axis=1)
        sure = ranked[:, -1] - ranked[:, -2]
        pairs = s[:, f:]
        votes, margin, worst = (np.zeros((len(texts), len(LANGUAGES))) for _ in range(3))
        worst += np.inf
        for i, (a, b) in enumerate(_PAIRS):
            for k, sign in ((LANGUAGES.index(a), 1.0), (LANGUAGES.index(b), -1.0)):
                votes[:, k] += sign * pairs[:, i] > 0
                margin[:, k] += sign * pairs[:, i]
                worst[:, k] = np.minimum(worst[:, k], sign * pairs[:, i])
        inside = np.array([[x in m for x in LANGUAGES] for m in FAMILIES.values()])[family]
        rank = np.where(inside, votes * 1e6 + margin, -np.inf)
        best = rank.argmax(axis=1)
        least = np.minimum(sure, worst[np.arange(len(texts)), best])
        trust = 1 / (1 + np.exp(-3 * least * (sizes / (sizes + SHORT)) ** 2))
        return [(LANGUAGES[k], float(c) if n else 0.0) for k, c, n in zip(best, trust, sizes)]


def svm(x: list[np.ndarray], y: np.ndarray, epochs: int = 4, c: float = 1e-4, seed: int = 3, batch: int = 8) -> np.ndarray:
    """Linear support vector machine by averaged stochastic subgradient steps over small batches."""
    w, mean, rng, t = np.zeros(1 << BITS), np.zeros(1 << BITS), np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            part = order[k : k + batch]
            at, value = np.concatenate([x[i][0] for i in part]), np.concatenate([x[i][1] for i in part])
            sizes = [len(x[i][0]) for i in part]
            margin = y[part] * np.add.reduceat(w[at] * value, np.cumsum([0] + sizes[:-1]))
            t += len(part)
            if (margin < 1).any():
                np.add.at(w, at, 0.5 / (1 + c * t) * np.repeat(np.where(margin < 1, y[part], 0), sizes) * value)
        w *= 1 - c
        mean += w
    return mean / epochs


def fit(examples: list[tuple[str, dict[str, int]]]) -> np.ndarray:
    """Weights of every classifier from (language, words) examples."""
    x = []
    for _, words in examples:
        n, total = sum(words.values()), Counter()
        for w, k in words.items():
            h = hashed(w)
            for j in h:
                total[j] += k / np.sqrt(len(h))
        x.append((np.fromiter(total.keys(), int, len(total)), np.fromiter(total.values(), float, len(total)) / max(n, 1)))
    langs = [e[0] for e in examples]
    weights = []
    for model in _MODELS:
        if model[0] == "family":
            rows = range(len(langs))
            y = [1 if langs[i] in FAMILIES[model[1]] else -1 for i in rows]
        else:
            rows = [i for i, v in enumerate(langs) if v in model]
            y = [1 if langs[i] == model[0] else -1 for i in rows]
        weights.append(svm([x[i] for i in rows], np.array(y)) if len(set(y)) > 1 else np.zeros(1 << BITS))
    return np.array(weights)


def train(docs: DataFrame, per_label: int = PER_LABEL) -> np.ndarray:
    """Weights learned from the documents' own labels, of which some are wrong.

    At most ``per_label`` documents of a label, chosen by hash, give their paragraphs;
    those that a first fit takes for another language are left out of the second.
    """
    known = docs.select("text", label_language(F.col("lang")).alias("language")).where("language IS NOT NULL AND length(text) > 40").distinct()
    sizes = {r.language: r["count"] for r in known.groupBy("language").count().collect()}
    if not sizes:
        return np.zeros((len(_MODELS), 1 << BITS), dtype=np.float32)
    share = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_label / n))))
    picked = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.element_at(share, F.col("language")) * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(lang, dict(Counter(words_of(p)))) for lang, t in zip(b["language"], b["text"]) for p in _BLANK.split(t) if p.strip() and not _is_label(p)]
            yield pd.DataFrame([r for r in out if sum(r[1].values()) >= 4], columns=["language", "words"])

    rows = [(r.language, dict(r.words)) for r in picked.mapInPandas(count, "language string, words map<string,int>").collect()]
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0], sorted(r[1].items())))
    model = Model(fit(rows))
    read = model.languages([list(Counter(r[1]).elements()) for r in rows])
    clean = [r for r, (lang, _) in zip(rows, read) if lang == r[0]]
    return fit(clean).astype(np.float32)


_RESULT = "main string, main_confidence double, segments array<struct<seg_no int, lang string, confidence double, words int>>"


def read_documents(texts: list[str | None], model: Model) -> list[tuple]:
    """(main language, confidence, [(paragraph, language, confidence, words)]) of every text.

    Paragraphs of markup, names or a short label have no language and are left out; all
    others have one, a short one with low confidence. The main language is that of most of
    the text, by words. 'other': written in foreign letters, or like none of the
    languages. All null for a text without any words.
    """
    found: list[tuple[int, int, list[str], bool]] = []  # text, paragraph, words, is foreign
    for i, text in enumerate(texts):
        if not text or text.isspace():
            continue
        whole = []
        for n, p in enumerate(x for x in _BLANK.split(text.replace("\r\n", "\n")) if x.strip()):
            strange = is_foreign(p)
            if (words := words_of(p)) and not _is_label(p) or strange:
                whole.append((i, n, words, strange))
        if not whole:
            words = words_of(text)
            whole = [(i, -1, words, False)] if words else []
        found += whole
    read = model.languages([f[2] for f in found])
    parts: list[list[tuple]] = [[] for _ in texts]
    for (i, n, words, strange), (lang, sure) in zip(found, read):
        parts[i].append((n, OTHER if strange or sure < LEAST else lang, sure, max(len(words), 1)))
    return [_main(p) for p in parts]


def _main(parts: list[tuple]) -> tuple:
    if not parts:
        return None, None, []
    weight: Counter[str] = Counter()
    for _, lang, _, size in parts:
        weight[lang] += size * (0.5 if lang == "ja" else 1)  # two letters to a word
    main = max(weight, key=lambda k: (weight[k], k))
    own = [(s, size) for _, lang, s, size in parts if lang == main]
    trust = sum(s * size for s, size in own) / sum(size for _, size in own)
    return main, trust, [p for p in parts if p[0] >= 0]


def _is_label(p: str) -> bool:
    p = p.strip()
    return "\n" not in p and len(p) < 90 and not re.search(r"[.!?。！？]['\"»”’)]*$", p) and bool(re.match(r"^[^.!?。]{1,40}[:：]", p) or p[:1] in "(（[")


def document_languages(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Adds ``main``, ``main_confidence`` and ``segments`` to every row of ``docs`` (text,
    lang); null, null and none for null, blank or wordless texts. Without any label to
    learn from every text is 'other'."""
    weights = train(docs) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded: classifiers x hash size
    held: list[Model] = []

    @F.pandas_udf(_RESULT)
    def read(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Model(shared.value))
        got = read_documents(list(texts), held[0])
        segments = [[{"seg_no": a, "lang": b, "confidence": c, "words": d} for a, b, c, d in g[2]] for g in got]
        return pd.DataFrame({"main": [g[0] for g in got], "main_confidence": [g[1] for g in got], "segments": segments})

    return docs.withColumn("_r", read("text")).select("*", "_r.*").drop("_r")


def relabelled(docs: DataFrame, least: float = 0.65) -> DataFrame:
    """(doc_id, seg_no, lang, confidence) of labels to be put right.

    seg_no -1: the document's label is missing, names no language or not that of most of
    its text; n: its n-th paragraph is in another language than most of the text, with at
    least ``least`` confidence. Repeated rows count once; blank texts give nothing. A
    text is read once, and only what is found leaves its row. What is in none of the
    languages is no case, as it has no right label.
    """
    read = document_languages(docs.select("doc_id", "text", "lang")).where(F.col("main") != OTHER)
    item = lambda n, lang, sure: F.struct(n.alias("seg_no"), lang.alias("lang"), sure.alias("confidence"))
    other = F.filter("segments", lambda s: (s["lang"] != F.col("main")) & (s["lang"] != OTHER) & (s["confidence"] >= least))
    parts = F.transform(other, lambda s: item(s["seg_no"], s["lang"], s["confidence"]))
    wrong = ~label_language(F.col("lang")).eqNullSafe(F.col("main"))
    whole = F.when(wrong, F.array(item(F.lit(-1), F.col("main"), F.col("main_confidence")))).otherwise(F.slice(parts, 1, 0))
    rows = read.select("doc_id", F.explode(F.concat(whole, parts)).alias("x"))
    return rows.select("doc_id", "x.*").groupBy("doc_id", "seg_no", "lang").agg(F.max("confidence").alias("confidence"))
