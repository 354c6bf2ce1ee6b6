"""Personal information in free text: a linear-chain conditional random field over word shapes.

Every feature belongs to one token at one distance, so the score of a token type for each
label and distance is a row of a table: tagging a text is looking up its tokens, adding
shifted rows and one batched Viterbi pass, all in numpy.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumdf.llm.chars import fold_char
from quorumdf.llm.pii_examples import sequences
from quorumdf.plans.skew import spread

KINDS = ("name", "email", "phone", "id", "address")
#: Kinds as the results name them, and the placeholder of each.
NAMED = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address"}
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 4
TRAINING_TEXTS = 8000
ROUNDS = 40
#: Token types whose scores a worker keeps (400 bytes each) before it starts afresh.
MOST_TYPES = 200_000
#: Names of the list that are read at most; the rest of a longer list is an error, not cut off.
MOST_NAMES = 1_000_000

_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?| dot )"
#: Tokens: mail addresses (also spelled out), handles, titles and initials with their dot, whole runs of digit groups, words with inner marks, line ends, single signs.
_TOKEN = re.compile(
    rf"[\w.+-]+@[\w-]+(?:\.\w+)+|[\w.+-]+(?: @ |\s?[\[(]at[\])]\s?)[\w-]+(?:{_DOT}\w+)*|[\w.+-]+ at [\w-]+(?:{_DOT}\w+)+(?![\w.+-]*\s?(?:@|[\[(]at\b|at\b))|@\w+"
    r"|(?<!\w)(?<!0 )(?:dra?|mrs?|ms|prof|sra?|st|hr|fr|dhr|mevr|mme|mlle|[^\W\d_])\.(?=\s?\w)|(?<!\w)[+(]?0[0()]*(?:(?:[ ./-]|\) ?| \(|[ -]?\()0[0()]*)+(?![\w@]|[./-]\w)|\w+(?:[.+'’/_-]\w+)*|\n|[^\w\s]",
    re.I,
)
#: What a token with a mail address, or a handle, has in it, other than the signs of :func:`_mailed`.
_SPOKEN = re.compile(rf" at [\w-]+{_DOT}\w", re.I)
#: Blanks at which a text without such tokens is cut into pieces: no token crosses them, and none looks across, as that takes an end of digits, a bracket or a full stop before them.
_CUT = re.compile(r" (?<![0().] )")
_DIGITS = re.compile("0+")
#: Features that name a word; in fitting a share of the words is without them, as words not met before will be.
_WORDY = ("w=", "-4=", "-3=", "+4=", "-2=")
DROPPED = 0.5
#: Weight of a token's features by distance.
NEARNESS = (0.15, 0.25, 0.5, 0.9, 2.0, 0.9, 0.5, 0.25, 0.15)
# Beginnings of words that announce a kind of item, in several languages.
_CUE_STARTS = {
    "phone": tuple("call phone tel tél mob cell dial ring text sms fax land whatsapp hand telef anruf ruf rück appel llam liga ligu bel звон позвон тел моб number nummer número numéro номер".split()),
    "mail": tuple("mail e-mail email write reply login log cc bcc copy schreib antwort escrib copia correo écri répond copie adresse escrev stuur пиш почт копи".split()),
    "id": tuple("ssn social passport pass ausweis personal identit identi national insurance tax steuer tin dni nie nif cpf bsn инн снилс паспорт citizen driving licence secur sécur segur fiscal health".split()),
    "street": tuple("street st road rd lane avenue ave drive square court close gardens way hill boulevard flat apt apartment unit suite house rue place allée calle c avenida av plaza paseo rua ул улица дом кв via am".split()),
    "home": tuple("address live moved move home ship deliver anschrift adresse wohn zieh dirección domicilio vivo entreg livr habit morada endereço moro adres woon адрес живу достав".split()),
    "title": tuple("mr mrs ms miss mister sir madam lady dr doctor prof herr herrn frau señor señora señorita sr sra don doña monsieur madame mademoiselle mme mlle me dona senhor senhora meneer mevrouw dhr mevr doktor professor господ госпож доктор dra".split()),
    "relation": tuple("brother sister husband wife son daughter aunt uncle mother father colleague neighbour neighbor boss friend manager technician agent clerk driver landlord partner courier bruder schwester kollege kollegin mann frau nachbar chef freund techniker hermano hermana colega vecino vecina jefe amigo técnico frère sœur collègue voisin mari ami technicien irmão irmã vizinho amigo broer zus buurman vriend brat брат сестра коллега сосед друг техник".split()),
    "sign": tuple("signed signé signature unterschr firmado firma assinado ondertek getekend подпис sent behalf auftrag".split()),
    "close": tuple("regards sincerely yours best cheers greetings wishes gruß grüß grüsse hochachtungsvoll saludos atentamente cordial abrazo salutations amicalement atenciosamente abraços obrigado groet уважением свидания всего truly warm love".split()),
    "talk": tuple("spoke speak talk told tell ask meet met thank hear heard gave give hand sprach sprech gesproch frag geben hablé habl dijo pregunt parlé parl demand donn falei falar sprak vraag говор сказ спрос переда позов".split()),
    "self": tuple("am i'm name named called bin heiß heiss nenn soy llamo llaman nombre suis appelle nom sou chamo nome ben heet naam зовут имя я this here speaking hier aquí ici".split()),
    "field": tuple("contact customer client recipient caller attn holder owner guest member passenger patient tenant subscriber cardholder account person kunde kontakt ansprech empfäng cliente contacto destinat destinataire klant клиент получат".split()),
    "thing": tuple("product model brand city branch device office plan version item shop level place region subject produkt filiale gerät ort tarif producto oficina aparato ciudad produit agence appareil forfait ville продукт прибор филиал тариф город".split()),
    "at": tuple("in from at for to into near between via since after before by with aus nach bei mit für von zwischen seit ab en desde entre con por para hasta tras à chez avec par pour depuis sans em com uit naar voor из в между с для после от".split()),
    "firm": tuple("ltd gmbh inc group ag company co bank partners s.a b.v logistics app portal plan branch office product version model store filiale tarif oficina agence".split()),
}
_STREET_END = ("straße", "strasse", "weg", "gasse", "platz", "allee", "str", "straat", "laan", "plein", "steig", "ring")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_BAR = re.compile(r"[^\W\d_]+")


class _Folds(dict):
    """Of each character's code what it is folded to, without accents and joiners; ``odd`` are those that become none or several."""

    def __init__(self):
        self.odd: set[str] = set()

    def __missing__(self, code: int) -> str:
        folded = self[code] = "".join(f for f in fold_char(chr(code)) if not "\u0300" <= f <= "\u036f" and f != "\u200d")
        if len(folded) != 1:
            self.odd.add(chr(code))
        return folded


_FOLDS = _Folds()


def aligned(text: str) -> tuple[str, list[int] | None]:
    """The text with each character folded on its own, and for each folded character its place in the text (None: the same)."""
    if text.isascii():
        return text, None
    folded = text.translate(_FOLDS)
    if _FOLDS.odd.isdisjoint(text):
        return folded, None
    at = [i for i, c in enumerate(text) for _ in _FOLDS[ord(c)]]
    at.append(len(text))
    return folded, at


def _zeroed(text: str) -> str:
    """The text with each digit 1 to 9 as a zero; none of these bytes is part of another character."""
    return text.encode("utf-8", "surrogatepass").translate(_ZEROS).decode("utf-8", "surrogatepass")


def _mailed(text: str) -> bool:
    """Whether a token of mail addresses or handles may be in the text."""
    low = text.lower()
    return "@" in text or "(at" in low or "[at" in low or " at " in low and _SPOKEN.search(text) is not None


def _fold_labelled(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    folded, at = aligned(text)
    return (text, spans) if at is None else (folded, [(bisect_left(at, a), bisect_left(at, b), kind) for a, b, kind in spans])


def _shape(token: str) -> str:
    out = []
    for c in token:
        out.append("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c)
    return "".join(out)


_CUES: dict[str, list[str]] = {}
for _kind, _starts in _CUE_STARTS.items():
    for _start in _starts:
        _CUES.setdefault(_start, []).append(f"cue={_kind}")


def _cues(low: str) -> list[str]:
    """Kinds that a word announces: beginnings of up to three letters must be the whole word."""
    out = {c for i in range(4, min(len(low), 9) + 1) for c in _CUES.get(low[:i], ())}
    out.update(_CUES.get(low, ()))
    if low.endswith(_STREET_END) and len(low) > 5:
        out.add("cue=end")
    return sorted(out)


def token_features(token: str, listed) -> list[str]:
    """Features of one token by itself; digits are zeros already."""
    if token == "\n":
        return ["nl"]
    low = token.lower()
    if token[-1] == "." and len(token) > 1:
        name = low[:-1]
        return ["w=" + low, "initial" if len(name) == 1 else "abbr", "cap=" + ("Aa" if token[0].isupper() else "a"), *_cues(name)]
    if token[0] == "@":
        return ["@", "@h"] if len(token) > 1 else ["@", "w=@"]
    if "@" in token:
        domain = token.rsplit("@", 1)[1].strip()
        return ["@", "@n" if domain.replace(".", "").replace("0", "") == "" else "@m"]
    if " " in low and not low[0] in "0+(" or low.endswith((")", "]")) and "at" in low:
        return ["@", "@s", "@s." if "." in low or "dot" in low else "@s-"]
    shape = _shape(token)
    short = re.sub(r"(.)\1+", r"\1", shape)
    out = ["w=" + low, "s=" + short]
    if any(c.isdigit() for c in token):
        groups = _DIGITS.findall(token)
        out += ["d=" + shape.upper()[:24], f"n={min(16, sum(map(len, groups)))}", f"g={min(6, len(groups))}", "gl=" + ".".join(str(len(x)) for x in groups[:6]), "first=" + short[0], "marks=" + "".join(sorted(set(short) - set("0Xx")))]
        if "x" in short.lower():
            out.append("mix")
        if len(groups) == 1 and len(groups[0]) == len(token):
            out.append("bare")
    elif token[0].isalpha():
        caps = "A" if token.isupper() and len(token) > 1 else "a" if token[0].islower() else "Aa"
        out += ["-3=" + low[-3:], "-4=" + low[-4:], "-2=" + low[-2:], "+4=" + low[:4], "cap=" + caps, f"l={min(len(token), 9)}", *_cues(low)]
        parts = _BAR.findall(low)
        if any(p in listed for p in parts) or low in listed:
            out += ["listed", "listed" + caps]
        else:
            out.append("other" + caps)
        if len(parts) > 1:
            out.append("dots" if "." in token else "bars")
    else:
        out.append("p")
    return out


class Tagger:
    def __init__(self, listed):
        self.listed = listed
        self.features: dict[str, int] = {}
        self.weights = np.zeros((2 * REACH + 1, 0, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.first = np.zeros(len(LABELS))
        self.types: dict[str, int] = {}
        self.table = np.zeros((2 * REACH + 1, 1, len(LABELS)), np.float32)  # row 0: beyond the ends
        self.fresh: list[str] = []
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.most = MOST_TYPES

    def with_list(self, names) -> Tagger:
        """The same tagger with another list of known names."""
        own = Tagger(frozenset(names))
        own.features, own.weights, own.moves, own.first = self.features, self.weights, self.moves, self.first
        return own

    # -- fitting -----------------------------------------------------------------------------------------------------
    def fit(self, texts: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = ROUNDS, penalty: float = 5e-2, step: float = 0.15, seed: int = 5) -> None:
        texts = [_fold_labelled(t, spans) for t, spans in texts]
        cut = [[m for m in _TOKEN.finditer(_zeroed(t))] for t, _ in texts]
        gold = []
        for (_, spans), tokens in zip(texts, cut):
            tags = np.zeros(len(tokens), np.int64)
            for a, b, kind in spans:
                inside = [i for i, m in enumerate(tokens) if m.start() >= a and m.end() <= b]
                for k, i in enumerate(inside):
                    tags[i] = LABELS.index(("I-" if k else "B-") + kind)
            gold.append(tags)
        names = sorted({m[0] for tokens in cut for m in tokens})
        of = {t: token_features(t, self.listed) for t in names}
        seen = Counter(f for tokens in cut for t in {m[0] for m in tokens} for f in of[t])
        self.features = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
        index = {t: i + 1 for i, t in enumerate(names)}
        wordy = np.array([f.startswith(_WORDY) for f in self.features])
        pairs = [(index[t], self.features[f]) for t in names for f in of[t] if f in self.features]
        row, col = (np.array(x, np.int64) for x in zip(*pairs))
        n_types, n_features, n_labels = len(names) + 1, len(self.features), len(LABELS)
        lengths = np.array([len(t) for t in cut])
        order = np.argsort(lengths, kind="stable")
        batches = [order[i : i + 160] for i in range(0, len(order), 160)]
        reach = 2 * REACH + 1
        near = np.repeat(np.array(NEARNESS, np.float32), n_labels)
        params = [np.zeros((n_features, reach * n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
        speed = [np.full_like(p, 1e-8) for p in params]
        rng = np.random.default_rng(seed)
        ready = []
        for b in batches:
            width = int(lengths[b].max())
            ids = np.zeros((len(b), width + 2 * REACH), np.int64)
            tags = np.zeros((len(b), width), np.int64)
            for k, i in enumerate(b):
                ids[k, REACH : REACH + lengths[i]] = [index[m[0]] for m in cut[i]]
                tags[k, : lengths[i]] = gold[i]
            used = np.unique(ids)
            own = np.isin(row, used)
            ready.append((np.searchsorted(used, ids), tags, lengths[b], len(used), np.searchsorted(used, row[own]), col[own]))
        for epoch in range(rounds // 4):
            for k in rng.permutation(len(ready)):
                ids, tags, size, n_used, r, c = ready[k]
                kept = ~wordy[c] | (rng.random(n_used) >= DROPPED)[r]
                r, c = r[kept], c[kept]
                w, moves, first = params
                scores = (_summed(w[c], r, n_used) * near).reshape(n_used, reach, n_labels)
                width = tags.shape[1]
                emit = sum(scores[ids[:, o : o + width], o] for o in range(reach))
                d_emit, d_moves, d_first = _gradient(emit, moves, first, tags, size)
                moved = np.zeros((*ids.shape, reach, n_labels), np.float32)
                for o in range(reach):
                    moved[:, o : o + width, o] = d_emit
                by_type = _summed(moved.reshape(-1, reach * n_labels), ids.ravel(), n_used) * near
                for p, g, s in zip(params, (_summed(by_type[r], c, n_features), d_moves, d_first), speed):
                    g = g / len(size) - penalty / 100 * p
                    s += g * g
                    p += step * g / np.sqrt(s)
        self.weights = (params[0] * near).reshape(n_features, reach, n_labels).transpose(1, 0, 2).astype(np.float32)
        self.moves, self.first = params[1].astype(np.float32), params[2].astype(np.float32)
        banned = np.zeros_like(self.moves)
        for b, label in enumerate(LABELS):
            if label[0] == "I":
                banned[[a for a, x in enumerate(LABELS) if x[2:] != label[2:]], b] = -1e4
                self.first[b] -= 1e4
        self.moves = self.moves + banned

    # -- tagging -----------------------------------------------------------------------------------------------------
    def _type(self, token: str) -> int:
        if len(self.types) >= self.most:
            raise OverflowError
        i = self.types[token] = len(self.types) + 1
        self.fresh.append(token)
        return i

    def _ids(self, text: str) -> list[int]:
        """The types of the text's tokens.  A piece met before is not cut into tokens again."""
        text = _zeroed(text)
        if _mailed(text):
            return [self.types.get(t) or self._type(t) for t in _TOKEN.findall(text)]
        out: list[int] = []
        for piece in _CUT.split(text):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= self.most:
                    self.pieces.clear()
                ids = self.pieces[piece] = tuple(self.types.get(t) or self._type(t) for t in _TOKEN.findall(piece))
            out += ids
        return out

    def _score_fresh(self) -> None:
        rows = np.zeros((2 * REACH + 1, len(self.fresh), len(LABELS)), np.float32)
        for k, token in enumerate(self.fresh):
            ids = [self.features[f] for f in token_features(token, self.listed) if f in self.features]
            if ids:
                rows[:, k] = self.weights[:, ids].sum(axis=1)
        self.table = np.concatenate([self.table, rows], axis=1)
        self.fresh = []

    def tag(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the items in each text, as places in it.  Null and empty texts have none."""
        folded = [aligned(t) if t else ("", None) for t in texts]
        ids: list[np.ndarray] = []
        for text, _ in folded:
            try:
                ids.append(np.array(self._ids(text), np.int32))
            except OverflowError:  # forget the types and start over with half the texts; only speed depends on it
                self.types, self.pieces, self.fresh, self.table = {}, {}, [], self.table[:, :1]
                half = len(texts) // 2
                if half:
                    return self.tag(texts[:half]) + self.tag(texts[half:])
                self.most *= 2  # one text with more words than that
                return self.tag(texts)
        if self.fresh:
            self._score_fresh()
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            last = at + 1
            while last < len(order) and (last - at + 1) * len(ids[order[last]]) <= 60_000:
                last += 1
            part = order[at:last]
            at = last
            for i, tags in zip(part, self._viterbi([ids[i] for i in part])):
                if tags.any():
                    out[i] = self._spans(tags, *folded[i])
        return out

    def _viterbi(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        size = np.array([len(x) for x in ids])
        width = int(size.max())
        padded = np.zeros((len(ids), width + 2 * REACH), np.int32)
        for k, x in enumerate(ids):
            padded[k, REACH : REACH + len(x)] = x
        emit = self.table[0][padded[:, :width]]
        for o in range(1, 2 * REACH + 1):
            emit += self.table[o][padded[:, o : o + width]]
        total = emit[:, 0] + self.first
        back = np.zeros((width, len(ids), len(LABELS)), np.int8)
        live = np.searchsorted(size, np.arange(width), side="right")  # rows are sorted by size
        for t in range(1, width):
            a = live[t]
            reach = total[a:, :, None] + self.moves
            back[t, a:] = reach.argmax(axis=1)
            total[a:] = np.take_along_axis(reach, back[t, a:, None, :].astype(np.int64), axis=1)[:, 0] + emit[a:, t]
        tags = np.zeros((len(ids), width), np.int8)
        best = total.argmax(axis=1)
        rows = np.arange(len(ids))
        for t in range(width - 1, -1, -1):
            inside = size > t
            tags[inside, t] = best[inside]
            step = size > t + 0
            best = np.where(step & (t > 0), back[t, rows, best], best)
        return [tags[k, : size[k]] for k in range(len(ids))]

    def _spans(self, tags: np.ndarray, text: str, at: list[int] | None) -> list[tuple[int, int, str]]:
        tokens = list(_TOKEN.finditer(_zeroed(text)))
        spans: list[list] = []
        for tag, m in zip(tags, tokens):
            if not tag:
                continue
            prefix, kind = LABELS[tag].split("-")
            if prefix == "B" or not spans:
                spans.append([m.start(), m.end(), kind])
            else:
                spans[-1][1] = m.end()
        if at is None:
            return [tuple(s) for s in spans]
        return [(at[a], at[b - 1] + 1, kind) for a, b, kind in spans]


def _summed(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of ``n`` groups."""
    order = np.argsort(group, kind="stable")
    own, start = np.unique(group[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[own] = np.add.reduceat(rows[order], start, axis=0)
    return out


def _gradient(emit: np.ndarray, moves: np.ndarray, first: np.ndarray, tags: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood of the gold tags: observed less expected counts, by scaled forward-backward over a padded batch."""
    n, width, k = emit.shape
    inside = np.arange(width) < size[:, None]
    chance, step = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(moves)
    unit = lambda x: x / x.sum(axis=1, keepdims=True)
    alpha, beta = np.empty((width, n, k)), np.ones((width, n, k))
    alpha[0] = unit(chance[:, 0] * np.exp(first - first.max()))
    for t in range(1, width):
        alpha[t] = np.where(inside[:, t, None], unit(alpha[t - 1] @ step * chance[:, t]), alpha[t - 1])
    for t in range(width - 2, -1, -1):
        beta[t] = np.where(inside[:, t + 1, None], unit(chance[:, t + 1] * beta[t + 1] @ step.T), 1.0)
    post = alpha * beta
    d_emit = -(post / post.sum(axis=2, keepdims=True)).transpose(1, 0, 2) * inside[:, :, None]
    at = np.nonzero(inside)
    d_emit[(*at, tags[at])] += 1
    d_moves = np.zeros_like(moves)
    for t in range(1, width):
        ok = inside[:, t]
        left, right = alpha[t - 1][ok], chance[ok, t] * beta[t][ok]
        d_moves -= step * ((left / (left @ step * right).sum(axis=1, keepdims=True)).T @ right)
        np.add.at(d_moves, (tags[ok, t - 1], tags[ok, t]), 1)
    return d_emit, d_moves, d_emit[:, 0].sum(axis=0)


@lru_cache(maxsize=1)
def trained(count: int = TRAINING_TEXTS, rounds: int = ROUNDS, seed: int = 11) -> Tagger:
    """The tagger fitted on the labelled table; once per process."""
    texts, listed = sequences(count, seed)
    tagger = Tagger(frozenset(listed))
    tagger.fit(texts, rounds)
    return tagger


def tagger_for(names: DataFrame) -> Tagger:
    """The trained tagger with the names of a list (``name``) in place of the invented ones."""
    rows = [r[0] for r in names.filter("name is not null").select(F.lower("name")).distinct().take(MOST_NAMES + 1)]
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return trained().with_list(rows)


def bare(item: str) -> str:
    return "".join(c for c in item.lower() if c.isalnum())


def _run_tagger(df: DataFrame, tagger: Tagger, make, shape: str, keys: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                yield make(part, texts, own.tag(texts))

    return spread(df, *keys).mapInPandas(run, shape)


def gathered(tables: dict[str, tuple[DataFrame, str]], text: str = "text") -> DataFrame:
    """(table_name, row_id, text): all rows of the given tables (frame, id column)."""
    rows = None
    for name, (frame, key) in tables.items():
        one = frame.select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("row_id"), F.col(text).alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def found(tables: dict[str, tuple[DataFrame, str]], names: DataFrame, text: str = "text") -> DataFrame:
    """(table_name, row_id, kind, found): each distinct item of each text of the given tables (frame, id column)."""
    rows = gathered(tables, text)

    def make(part, texts, spans):
        out = []
        for table, rid, body, items in zip(part["table_name"], part["row_id"], texts, spans):
            out += {(table, rid, NAMED[kind], b) for a, z, kind in items if (b := bare(body[a:z]))}
        return pd.DataFrame(sorted(out), columns=["table_name", "row_id", "kind", "found"])

    return _run_tagger(rows, tagger_for(names), make, "table_name string, row_id long, kind string, found string", ["row_id"])


def redact(df: DataFrame, names: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """(``key``, redacted, items), for one key column or several: the text with every item replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    A null text stays null; ``items`` counts the replacements.
    """

    keys = [key] if isinstance(key, str) else key

    def make(part, texts, spans):
        done = []
        for body, items in zip(texts, spans):
            for a, z, kind in reversed(items):
                body = f"{body[:a]}[{NAMED[kind].upper()}]{body[z:]}"
            done.append(body)
        return pd.DataFrame({**{k: part[k] for k in keys}, "redacted": done, "items": [len(x) for x in spans]})

    rows, kinds = df.select(*keys, F.col(text).alias("text")), dict(df.dtypes)
    return _run_tagger(rows, tagger_for(names), make, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", redacted string, items int", keys)
