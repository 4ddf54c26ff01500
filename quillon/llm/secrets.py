"""Secret scans: fixed patterns, and random-looking strings found by character Markov models.

Two first-order models over classes of characters are trained from labelled samples, one of random
strings (keys, hex, base64), one of ordinary strings: identifiers (words in camel, snake and kebab case,
with numbers and paths), compounds of words of many languages, and invented words made of syllables. A candidate is a run of at least MIN_RUN key characters, which is the shortest
random string of the samples; it is a secret if its mean log-likelihood ratio per step is above a
threshold. Where a whole run is not, its best part between separators that is long enough may be, and
so on to the left and right of that, so that an identifier or path around a key does not hide it.
Runs of fewer than LEAST_KINDS different characters (rules, fillers) are not random: a random
hexadecimal string of MIN_RUN has so few with chance 4e-7.

The fixed patterns always count; they cut the runs, and the models add spans in what lies between.

Defined results: a null or empty text has no spans; a null id is kept; offsets are code points, ends
exclusive; extra columns are ignored; repeated rows give repeated results; an empty table gives an
empty result; texts are scanned whole, in one walk beside the sorted base spans.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more; a run is one match, so a shorter one fails as a whole
HEX = re.compile(r"[0-9a-f]{32,}")
#: One of these is in every lower-cased text with an assign match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
MIN_RUN, LEAST_KINDS = 16, 5
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
PART = re.compile(r"[A-Za-z0-9+]+")
THRESHOLD = 0.25
#: Most labelled strings of each label that train() uses.
TRAIN_ROWS = 20_000

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
INDEX = np.full(128, -1, np.int64)
INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Words of ordinary identifiers (fixed values).
WORDS = (
    "account action active address admin agent alert amount answer archive array author average backup balance base batch block board body branch "
    "bridge browser bucket buffer build button cache call camera cart catalog category center change channel check child class click client clock cloud "
    "cluster code color column command comment common company component config connection console contact content context control cookie copy count "
    "country create current customer data database date debug default delete delivery demo design detail device dialog digital directory disk display "
    "document domain download driver edit editor email empty enable engine entity entry error event example export external factory failure feature "
    "field file filter final first folder footer format forum frame function gallery game gateway general global graph group handler header health "
    "height help history home host hour icon image import include index info input insert install internal item join journal key label language "
    "large last layer layout length level library license light limit line link list load local location lock login machine mail main manager map "
    "market master match media member memory menu message method minute mobile mode model module monitor month music name network news node note "
    "number object office offset open option order output owner package page panel parent partner password patch path payment people phone photo "
    "plan platform player plugin point policy port position post power price print private process product profile project property proxy public "
    "query queue random range read record region register release remote remove report request reset resource response result review right role "
    "root route rule sample schedule schema screen script search second section secret secure select send server service session setting share shop "
    "side sign site size small social source space special stack staff start state static status step storage store stream string style subject "
    "submit summary support switch symbol system table target task team temp template test text theme thread time title token tool total track "
    "transfer tree type unit update upload user utility value vendor version video view visit volume warning watch web weight widget width window "
    "word work world write year zone"
).split()
#: Words and names of other languages, in ASCII letters (fixed values).
FOREIGN = (
    "aujourd bonjour toujours beaucoup travail oiseaux cheveux heureux ouvrier euxieme feuille bureaux ailleurs yeux "
    "geschwindigkeit wirtschaft schiff fahrt gesellschaft strasse haupt schluss buch verwaltung kraft werk pflicht jahr "
    "llan fair pwll gwyn gyll goger chwyrn drobwll llanty silio gogogoch cymru ysgol eyja fjalla jokull thing vellir snaefell hvolsvollur kirkju "
    "paivaa tyottomyys kuukausi lentokone hyvaa yliopisto jarvi szczescie chrzaszcz przyjaciel wszystko dziewczyna zmrzlina ctvrtek "
    "gracias desarrollo murcielago ferrocarril paraguas queria guerra cabeza lluvia giorno famiglia ragazzo bellezza sciogliere aiuola chiesa "
    "wetenschap nieuwsgierig zeeuws ijsvrij koeien coracao saudade trabalho ilha nguyen phuong khuong hawaii kalani humuhumu nukunuku apuaa oahu "
    "shinkansen kyoukai tsunami ryokan xiongmao zhuangyuan beijing qingdao mbongeni nkosi ubuntu ngozi"
).split()
#: Beginnings, middles and ends of syllables (fixed values).
ONSETS = "b bl br c ch cl cr d dr dw f fl fr g gh gl gn gr gw h hw j k kh kl kn kr l ll m n ng p ph pl pr q qu r rh s sc sch sh sk sl sm sn sp st str sv sw t th tr ts tw v vl w wh wr x y z zh".split()
NUCLEI = "a aa ae ai au e ea ee ei eau eu i ia ie io o oa oe oi oo ou u ue ui uo y".split()
CODAS = "b ch ck d ff g gh h k l ld ll lm lt m mp n nd ng nk nt p r rd rk rn rt s sch sk ss st t th tt v w x z".split()


def invented_word(rng: random.Random) -> str:
    """A word of syllables, some without a beginning or an end, so that any letters can meet."""
    optional = lambda parts: rng.choice(parts) if rng.random() < 0.5 else ""
    return "".join(optional(ONSETS) + rng.choice(NUCLEI) + optional(CODAS) for _ in range(rng.randint(3, 9)))


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, bool]]:
    """n random strings (True) and n ordinary ones (False: a half identifiers, a quarter compounds, a quarter invented words), made from the seed."""
    rng = random.Random(seed)
    b62, b64, hexa, upper = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits
    out: list[tuple[str, bool]] = []
    for _ in range(n):
        alphabet = rng.choice((b62, b62, b64, b62 + "_-", hexa, upper, string.ascii_lowercase + string.digits))
        out.append(("".join(rng.choices(alphabet, k=rng.randint(16, 64))), True))
        kind = rng.randrange(4)
        if kind < 2:
            word = invented_word(rng) if kind else "".join(rng.choices(FOREIGN, k=rng.randint(2, 5)))
            out.append((word.upper() if rng.random() < 0.08 else rng.choice((word, word.capitalize())), False))
            continue
        words = rng.choices(WORDS, k=rng.randint(2, 7))
        style = rng.randrange(6)
        name = {0: "_", 1: "-", 2: "/", 3: "", 4: "", 5: ""}[style].join(w if style < 3 or style == 5 else w.capitalize() for w in words)
        if rng.random() < 0.5:
            name += rng.choice(("", "_", "-", "/")) + str(rng.randint(0, 99999))
        if rng.random() < 0.15:
            name = name.upper()
        out.append((name, False))
    return out


class MarkovPair:
    """Log-likelihood ratios of the two models' steps from one character to the next."""

    def __init__(self, samples: Iterable[tuple[str, bool]], smoothing: float = 0.5, max_rows: int = TRAIN_ROWS):
        k = len(ALPHABET)
        counts, used = {True: np.full((k + 1, k), smoothing), False: np.full((k + 1, k), smoothing)}, {True: 0, False: 0}
        for text, is_random in samples:
            codes = self.codes(text)
            if len(codes) < 2 or used[bool(is_random)] >= max_rows:
                continue
            used[bool(is_random)] += 1
            np.add.at(counts[bool(is_random)], (np.concatenate(([k], codes[:-1])), codes), 1)
        if not all(used.values()):
            raise ValueError("samples of both labels are needed")
        logs = {label: np.log(c / c.sum(1, keepdims=True)) for label, c in counts.items()}
        self.ratio = logs[True] - logs[False]

    @staticmethod
    def codes(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("ascii", "ignore"), np.uint8)
        found = INDEX[raw & 127]
        return found[found >= 0]

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio per step; above 0 the random model fits better."""
        codes = self.codes(text)
        if len(codes) < 2:
            return 0.0
        return float(self.ratio[np.concatenate(([len(ALPHABET)], codes[:-1])), codes].mean())


@lru_cache(1)
def default_models() -> MarkovPair:
    return MarkovPair(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _gaps(start: int, end: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the base spans (sorted) leave of start to end."""
    for s, _, e in base:
        if s < end and start < e:
            if s > start:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def _random(run: str, models: MarkovPair, threshold: float) -> bool:
    return len(run) >= MIN_RUN and len(set(run)) >= LEAST_KINDS and models.score(run) > threshold


def best_part(run: str, models: MarkovPair, threshold: float) -> tuple[int, int] | None:
    """Start and end of the part between separators, MIN_RUN long or more, whose steps exceed the threshold by most in all."""
    codes = models.codes(run)
    over = np.concatenate(([0.0], np.cumsum(models.ratio[np.concatenate(([len(ALPHABET)], codes[:-1])), codes] - threshold)))
    parts = [m.span() for m in PART.finditer(run)]
    best, found, least, k = 0.0, None, None, 0
    for _, end in parts:
        while k < len(parts) and parts[k][0] <= end - MIN_RUN:
            least = parts[k][0] if least is None or over[parts[k][0]] < over[least] else least
            k += 1
        if least is not None and over[end] - over[least] > best:
            best, found = over[end] - over[least], (least, end)
    return found


def random_spans(run: str, models: MarkovPair, threshold: float) -> list[tuple[int, int]]:
    """The run if it is random as a whole, else its random parts."""
    if _random(run, models, threshold):
        return [(0, len(run))]
    out, rest = [], [(0, len(run))]
    while rest:
        start, end = rest.pop()
        if end - start >= MIN_RUN and (part := best_part(run[start:end], models, threshold)):
            s, e = start + part[0], start + part[1]
            if _random(run[s:e], models, threshold):
                out.append((s, e))
            rest += [(start, s), (e, end)]
    return out


def all_spans(text: str, models: MarkovPair, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed patterns' spans, and those together with the models' spans."""
    base = base_spans(text)
    solid: list[tuple[int, int, int]] = []  # what the base spans cover, without overlaps
    for s, k, e in base:
        if solid and s <= solid[-1][2]:
            solid[-1] = (solid[-1][0], k, max(e, solid[-1][2]))
        else:
            solid.append((s, k, e))
    added, k = [], 0
    for m in RUN.finditer(text):
        while k < len(solid) and solid[k][2] <= m.start():
            k += 1
        last = k
        while last < len(solid) and solid[last][0] < m.end():
            last += 1
        for s, e in _gaps(m.start(), m.end(), solid[k:last]):
            added += [(s + i, 3, s + j) for i, j in random_spans(text[s:e], models, threshold)]
    return base, sorted(base + added)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(models: MarkovPair, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, lines = ([], [], []), [], []
            for text in texts(batch):
                base, every = all_spans(text, models, threshold)
                for k in range(3):
                    counts[k].append(sum(b[1] == k for b in base))
                shas.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(lines, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, models: MarkovPair | None = None, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) of every row."""
    src = id_text(docs, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    return map_arrow(src, _scan(models or default_models(), threshold), f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _clean(models: MarkovPair, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [t if t is None else redacted(t, all_spans(t, models, threshold)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    return run


def redact(docs: DataFrame, models: MarkovPair | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs, with the secrets in its text column replaced; n_chars follows if there is one."""
    out = docs.mapInArrow(_clean(models or default_models(), threshold), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
