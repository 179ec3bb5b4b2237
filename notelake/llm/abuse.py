"""Abusive, hateful or sexual content.

Method: weak supervision. Voters look at one sentence each, after folding away the usual disguises (look-alike letters,
invisible characters, digits for letters, stretched and spaced letters). They read general lexicons of five languages
(``lexicon``), alone and by patterns of grammar: an insult near a second person, a group with what is said to attack it, a
verb of violence with its victim; others hear the trade's own meanings and rules that mention such words. How often each
pattern of votes occurs is counted over all documents. For each kind of abuse a generative label model then estimates by
expectation maximisation how often each voter speaks on abusive and on other sentences, and which voters go together: in
both classes the votes form a tree of pairwise dependencies (that of the greatest mutual information). The majority of the
votes is the prior, and the model gives each pattern of votes its posterior.

A linear classifier on the votes and on hashed runs of five bytes is trained on sentences with these posteriors as
labels (at most ``SAMPLE`` sentences of at most ``LONGEST`` characters, half of them with votes and these in misspelt forms
too, a quarter with words of the lexicons but no vote; no reviewer's verdict is used) and scores every sentence of every document. A document's score is its highest
sentence's.

Defined results: null, empty and blank texts score 0; texts are read whole; quotes and code count; a fragment of fewer
than four letters is read with what follows, a line without breaks in parts; a null source is a source of its own in the rates; repeated ids give a row
each; with an empty table nothing is trained and nothing scored; further columns are ignored. Results do not depend on
the order or the partitions of the rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import lexicon as L
from notelake.session import cut
from notelake.sources.tables import table

#: Sentences at most that the classifier is trained on.
SAMPLE = 24_000
#: Characters of a sentence at most, and those that two parts of a longer one share.
LONGEST, SHARED = 600, 100
#: Characters of a scrap at most.
SCRAP = 24
#: Score from which a document counts as abusive.
THRESHOLD = 0.5
#: Misspelt forms that the classifier learns of each sentence with votes.
VARIANTS = 3
#: Weight of all sentences without votes together, against that of all others.
SILENT = 2.0
#: The classifier's value for a sentence without votes and known runs.
BIAS = -3.0
#: Runs added to a sentence's number when its value is scaled, so that single words tell little.
SHORT = 24
SLOTS = 1 << 17
GRAM = 5
#: Characters between a pronoun and what is said of it, or between a verb and its victim.
REACH, VICTIM = 32, 24

# Letters of other scripts that look like a Latin one.
ALIKE = str.maketrans("аеорсухіѕјԁһкмтвнгαορντικυ", "aeopcyxisjdhkmtbhraopvtiku")
LEET = str.maketrans("013457@$", "oieastas")

_SPACED = re.compile(r"(?<![a-z*])(?:[a-z][ .\-_]){3,}(?:[a-z](?![a-z])\.?)?")
_STRETCHED = re.compile(r"([a-z])\1\1+")
_LEET = re.compile(r"(?<=[a-z])[013457@$]+|[013457@$]+(?=[a-z])")
_MASKED = re.compile(r"(?<![\w*])[a-z]\*{2,}[a-z]{0,3}(?![\w*])|(?<![\w*])[a-z]{1,2}[*#]+[a-z]{1,3}(?![\w*])")
_BREAKS = re.compile("[.!?…][\\s\"'”’»)]+|[\r\n|]+")
_THAI = re.compile("[฀-๿]")
_THAI_BREAKS = re.compile("(?<=[฀-๿])\\s+|\\s+(?=[฀-๿])")
# what must be there before the slower replacements are worth a try
_FOREIGN = re.compile("[Ͱ-ԯ]")
_MAY_BE_SPACED = re.compile(r"[ .\-_][a-z][ .\-_][a-z](?![a-z])")
# marks on Latin letters, and invisible characters
_MARKS = re.compile("[̀-ͯ­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]+")
_GAPS = re.compile(r"[ .\-_]")
_FOUR = re.compile(r"[^\W\d_](?:[\W\d_]*[^\W\d_]){3}")


def fold(text: str) -> str:
    """Lower case without accents, invisible characters and the usual disguises."""
    s = text
    if not s.isascii():
        s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s))
        s = _MARKS.sub("", s).lower()
        if _FOREIGN.search(s):
            s = s.translate(ALIKE)
        s = s.replace("’", "'").replace("\xdf", "ss")
    else:
        s = s.lower()
    s = _LEET.sub(lambda m: m[0].translate(LEET), s)
    if _MAY_BE_SPACED.search(s):
        s = _SPACED.sub(lambda m: _GAPS.sub("", m[0]) + (" " if m[0][-1] in " ._-" else ""), s)
    return _STRETCHED.sub(r"\1", s)


def sentences(folded: str) -> list[str]:
    """The sentences; a scrap of fewer than four letters goes with the next one (the last with the one before). One of over
    ``LONGEST`` characters is read in parts of that length, of which neighbours share ``SHARED``."""
    parts = _BREAKS.split(folded)
    if _THAI.search(folded):
        parts = [q for p in parts for q in (_THAI_BREAKS.split(p) if _THAI.search(p) else (p,))]
    out: list[str] = []
    held = ""
    for p in parts:
        if held:
            p, held = f"{held} {p}", ""
        if len(p) > SCRAP or _FOUR.search(p):
            out.append(p)
        else:
            held = p.strip()
    if held and out:
        out[-1] = f"{out[-1]} {held}"
    elif held:
        out.append(held)
    if any(len(p) > LONGEST for p in out):
        step = LONGEST - SHARED
        out = [p[k : k + LONGEST] for p in out for k in range(0, max(1, len(p) - SHARED), step)]
    return out


# A sentence that has words of the lexicons but no vote.
NEAR = 1 << 30
LANGUAGES = ("en", "de", "fr", "es", "th")
# An unnamed group by its place in a sentence, for each language: a plural subject of which something is said.
_PLURAL = {
    "en": re.compile(r"\b(?:[a-z]{3,}s|people|folk|lot|bunch|kind|men|women),? (?:\w+ ){0,2}?(?:are|should|must|need to|ought to|do not|don't|can't|cannot|never|always|only|deserve|belong|just|and|all|again|stink|steal|breed|lie|smell|ruin|destroy)\b"),
    "de": re.compile(r"\b(?:alle|diese|die|solche) (?:\w+ ){0,2}?(?:sind|sollten?|sollen|gehor\w*|mussen|konnen|haben|stinken|klauen|lugen)\b"),
    "fr": re.compile(r"\b(?:les|ces|tous les|toutes les) (?:\w+ ){0,2}?(?:sont|devraient|doivent|ne|n'\w+|puent|volent|mentent)\b"),
    "es": re.compile(r"\b(?:los|las|esos|esas|estos|estas) (?:\w+ ){0,2}?(?:son|deberian|deben|no|huelen|apestan|roban|mienten|solo)\b"),
}
# People sent away from where others live or work.
_EXCLUDED = [
    re.compile(r"\b(?:out of|away from|leave|no place in|not welcome in|banned from) (?:our|my|this|the|your) (?:country|office|team|company|town|city|street|school|land|home|nation|building|department|continent|village|neighbourhood|world|planet)\b"),
    re.compile(r"\b(?:do not|don't|does not|doesn't|never) belong (?:here|in|on|among|with|near)\b|\bback to (?:your|their|his|her) (?:own )?(?:country|hole|cave|kind|village|continent|swamp)\b"),
    re.compile(r"\b(?:aus|raus aus) (?:unserem|meinem|diesem|dem) (?:land|buro|team|haus|betrieb|viertel|dorf)\b|\bgehor\w* nicht (?:hierher|in|zu)\b|\bzuruck in (?:ihr|euer|dein|sein) (?:land|loch|dorf)"),
    re.compile(r"\b(?:hors|dehors) de (?:notre|mon|ce|chez) |\bn'ont? rien a faire (?:ici|chez|dans)\b|\bretourn\w+ (?:dans|chez) (?:ton|leur|votre|eux|toi)"),
    re.compile(r"\bfuera de (?:nuestro|nuestra|mi|este|esta) |\bno (?:pertenecen?|pintan?) (?:nada )?(?:a|en|aqui)\b|\bvuelv\w+ a (?:tu|su|vuestro) (?:pais|agujero|tierra)"),
]
# Violence that is called for against others.
_VIOLENCE = [
    re.compile(r"\b(?:someone|somebody|we|they|you|i) (?:should|ought to|must|need to|have to|want to|would love to|will|gonna) (?:\w+ ){0,2}?(?:beat|shoot|hang|burn|drown|gas|stab|bomb|slap|punch|whip|castrate|execute|lynch|throw|put down|wipe out) (?:\w+ ){0,4}?(?:them|him|her|these|those|all|every)\b"),
    re.compile(r"\b(?:sollte|musste|muss|gehor\w*) (?:\w+ ){0,4}?(?:erschossen|erschlagen|aufgehangt|verbrannt|vergast|verprugelt|erschiessen|verprugeln|aufhangen|verbrennen|vergasen|ersaufen)\b"),
    re.compile(r"\b(?:faut|faudrait|devrait|merite\w*) (?:\w+ ){0,3}?(?:tuer|pendre|bruler|fusiller|frapper|noyer|gazer|tabasser|eliminer)\b"),
    re.compile(r"\b(?:hay que|habria que|deberian|merecen?) (?:\w+ ){0,3}?(?:matar\w*|colgar\w*|quemar\w*|fusilar\w*|pegar\w*|ahogar\w*|gasear\w*|exterminar\w*|apalear\w*)\b"),
]


class Voters:
    """The voters; ``NAMES[k]`` speaks by bit k. The first ``SPOKEN`` of them speak for abuse, the others about what surrounds it."""

    NAMES = (
        "insult", "insult near someone", "name said of someone", "demeaned insult", "someone demeaned", "silencing", "slur", "profanity at someone", "masked word",
        "group attacked", "plural attacked", "they attacked", "excluded", "violence to others", "stereotype", "threat", "violence to someone", "explicit", "bodily", "explicit with someone", "technical", "mention", "self", "compound", "second person",
    )
    SPOKEN = 20

    def __init__(self) -> None:
        self.first = self._finder({"insult": L.INSULT, "name": L.NAMES, "demean": L.DEMEAN, "slur": L.SLUR, "profanity": L.PROFANITY, "silence": L.SILENCE, "threat": L.THREAT, "harm": L.HARM, "attack": L.ATTACK, "stereotype": L.STEREOTYPE, "explicit": L.SEXUAL, "bodily": L.BODILY})
        self.then = self._finder({"second": L.SECOND, "third": L.THIRD, "they": L.THEY, "self": L.FIRST, "group": L.GROUP, "body": L.BODY, "technical": L.TECHNICAL, "mention": L.MENTION, "compound": L.COMPOUND})

    @staticmethod
    def _finder(lexicons: dict[str, dict[str, str]]):
        of: dict[str, set[tuple[str, int]]] = {}
        for kind, lexicon in lexicons.items():
            for number, language in enumerate(LANGUAGES):
                for w in L.entries({language: lexicon[language]}):
                    of.setdefault(fold(w), set()).add((kind, number))
        finder = ahocorasick.Automaton()
        for w, kinds in of.items():
            finder.add_word(w, (len(w), tuple(sorted(kinds)), w.isascii()))
        finder.make_automaton()
        return finder

    @staticmethod
    def _hits(finder, sentence: str) -> dict[str, list[tuple[int, int, int]]]:
        """Places ``(language, start, end)`` of the entries of each lexicon; Latin ones as whole words."""
        found: dict[str, list[tuple[int, int, int]]] = {}
        n = len(sentence)
        for last, (length, kinds, latin) in finder.iter(sentence):
            start, end = last + 1 - length, last + 1
            if latin and ((start and sentence[start - 1].isalnum()) or (end < n and sentence[end].isalnum())):
                continue
            for kind, language in kinds:
                found.setdefault(kind, []).append((language, start, end))
        return found

    def vote(self, sentence: str) -> int:
        found = self._hits(self.first, sentence)
        masked = ("*" in sentence or "#" in sentence) and _MASKED.search(sentence) is not None
        if not found and not masked:
            return 0
        found |= self._hits(self.then, sentence)
        get = lambda kind: found.get(kind, ())
        tongues = lambda kind: {h[0] for h in get(kind)}
        second = tongues("second")
        someone = second | tongues("third")

        def near(first: str, then: str, reach: int) -> bool:
            return any(a == b and 0 <= s - e <= reach for a, _, e in get(first) for b, s, _ in get(then))

        def touching(x: str, y: str) -> bool:
            return any(a == b and (0 <= t - e <= 2 or 0 <= s - f <= 2) for a, s, e in get(x) for b, t, f in get(y))

        # what is said of someone comes after the pronoun where the language is not Thai
        said = lambda kind: near("second", kind, REACH) or near("third", kind, REACH) or (4 in someone and 4 in tongues(kind))
        attacked = tongues("attack")
        plural = any(language in attacked and _PLURAL[name].search(sentence) for language, name in enumerate(LANGUAGES) if name in _PLURAL)
        bodily = len({h[1] for h in get("bodily")})
        votes = (
            bool(get("insult")),
            bool(tongues("insult") & second),
            said("name"),
            touching("demean", "insult") or touching("demean", "name"),
            said("demean"),
            bool(get("silence")),
            bool(get("slur")),
            bool(tongues("profanity") & second),
            masked,
            bool(tongues("group") & attacked),
            plural,
            near("they", "attack", REACH),
            any(x.search(sentence) for x in _EXCLUDED),
            any(x.search(sentence) for x in _VIOLENCE),
            bool(get("stereotype")),
            bool(get("threat")),
            near("harm", "second", VICTIM) or bool(tongues("harm") & tongues("body") & second) or (4 in tongues("harm") and 4 in second),
            bool(get("explicit")),
            bodily > 1 or bool(tongues("bodily") & second),
            bool(tongues("explicit") & someone),
        )
        if not any(votes):
            return NEAR
        about = (bool(get("technical")), bool(get("mention")), bool(get("self")), bool(get("compound")), bool(second))
        return sum(1 << k for k, v in enumerate((*votes, *about)) if v)


@cache
def voters_here() -> Voters:
    """The voters of this worker, built once."""
    return Voters()


# The kinds of abuse, each with the voters that speak for it; the others are heard in all.
KINDS = {"insult": (0, 1, 2, 3, 4, 5, 6, 7, 8), "hatred": (6, 9, 10, 11, 12, 13, 14), "threat": (13, 15, 16), "sexual": (17, 18, 19)}
AROUND = tuple(range(Voters.SPOKEN, len(Voters.NAMES)))
# What a vote counts in the majority that the label model starts from: words that have other meanings count half.
START = np.array([0.5, 1, 1, 1, 0.5, 1, 1, 0.5, 0.5, 1, 0.5, 0.5, 0.5, 0.5, 0.5, 1, 1, 0.5, 0.5, 1, -0.5, -1, -1, -1, 0])


def majority(votes: np.ndarray) -> np.ndarray:
    """Probability of abuse for a sum of votes by ``START``, before anything is learnt."""
    return 1 / (1 + np.exp(2 - 4 * votes))


def _tree(fires: np.ndarray, mass: np.ndarray) -> list[tuple[int, int]]:
    """``(voter, parent)`` from a root (parent -1) on: the tree of the greatest mutual information under the weights."""
    d, total = fires.shape[1], mass.sum()
    one = mass @ fires / total
    both = (fires * mass[:, None]).T @ fires / total
    info = np.zeros((d, d))
    for x in (0, 1):
        for y in (0, 1):
            px, py = (one if x else 1 - one), (one if y else 1 - one)
            joint = both if x and y else (one[:, None] - both) if x else (one[None, :] - both) if y else 1 - one[:, None] - one[None, :] + both
            joint = np.maximum(joint, 1e-12)
            info += joint * np.log(joint / np.maximum(px[:, None] * py[None, :], 1e-12))
    order, gain, parent = [(0, -1)], info[0].copy(), np.zeros(d, dtype=int)
    gain[0] = -np.inf
    for _ in range(d - 1):
        k = int(np.argmax(gain))
        order.append((k, int(parent[k])))
        gain[k] = -np.inf
        open_ = np.isfinite(gain)
        better = open_ & (info[k] > gain)
        gain[better], parent[better] = info[k][better], k
    return order


def _log_likelihood(fires: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Of each pattern under the tree of pairwise dependencies that the weighted patterns have."""
    out = np.zeros(len(fires))
    for voter, parent in _tree(fires, mass):
        x = fires[:, voter]
        above = fires[:, parent] if parent >= 0 else np.zeros(len(fires))
        for state in (0.0, 1.0):
            at = above == state
            # one sentence of either kind is added to those counted
            rate = (mass[at] @ x[at] + 1) / (mass[at].sum() + 2)
            out[at] += np.where(x[at] > 0, np.log(rate), np.log(1 - rate))
    return out


def label_model(counts: dict[int, int], rounds: int = 40) -> dict[int, float]:
    """Posterior of abuse for each pattern of votes; 0 for the silent one.

    For each kind of abuse, over the patterns in which one of its voters speaks: a mixture of two classes, in each of which
    the votes depend on one another by a tree; trees, rates and classes are estimated together, with the majority as the prior."""
    patterns = sorted(counts)
    harmless = np.ones(len(patterns))
    bits = np.array([[p >> k & 1 for k in range(len(Voters.NAMES))] for p in patterns], dtype=np.float64).reshape(len(patterns), len(Voters.NAMES))
    n = np.array([counts[p] for p in patterns], dtype=np.float64)
    for voters in KINDS.values():
        at = np.flatnonzero(bits[:, list(voters)].any(axis=1))
        if not len(at):
            continue
        mine = [*voters, *AROUND]
        fires, m = bits[at][:, mine], n[at]
        before = q = majority(fires @ START[mine])
        for _ in range(rounds):
            # a tree alone could hold what tells the classes apart, so each pattern's majority stays in as its prior
            z = np.log(before) - np.log(1 - before) + _log_likelihood(fires, m * q) - _log_likelihood(fires, m * (1 - q))
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        harmless[at] *= 1 - q
    return {p: float(1 - h) for p, h in zip(patterns, harmless)}


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashed runs of five bytes of all sentences, and where each sentence's begin (with a last border)."""
    parts = [f"  {t}  ".encode("utf-8", "replace") if t else b" " * (GRAM - 1) for t in texts]
    size = np.array([len(p) - GRAM + 1 for p in parts], dtype=np.int64)
    b = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    h = np.zeros(max(0, len(b) - GRAM + 1), dtype=np.uint32)
    for k in range(GRAM):
        h *= np.uint32(16777619)
        h ^= b[k : len(b) - GRAM + 1 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    h >>= np.uint32(32 - 17)
    # runs that cross from one sentence into the next are left out
    starts = np.concatenate([[0], np.cumsum(size + GRAM - 1)])
    keep = np.ones(len(h), dtype=bool)
    for k in range(1, GRAM):
        at = starts[1:-1] - k
        keep[at[at >= 0]] = False
    return h[keep], np.concatenate([[0], np.cumsum(size)])


def fired(votes: list[int]) -> np.ndarray:
    """The votes of each sentence as a row of zeros and ones."""
    return (np.array(votes, dtype=np.int64)[:, None] >> np.arange(len(Voters.NAMES)) & 1).astype(np.float64)


def logits(texts: list[str], votes: list[int], w: np.ndarray) -> np.ndarray:
    """The classifier's value for each sentence; the last weights are those of the votes."""
    # no sentence is empty, so each has runs of its own
    slots, at = grams(texts)
    return np.add.reduceat(w[slots], at[:-1], dtype=np.float64) / np.sqrt(np.diff(at) + SHORT) + fired(votes) @ w[SLOTS:] + BIAS


def _vote_weights(post: dict[int, float], rounds: int = 2_000, rate: float = 0.5) -> np.ndarray:
    """What the votes alone tell: logistic weights for the patterns' posteriors. A voter that never speaks in the corpus keeps
    the meaning it starts with."""
    seen = [(p, q) for p, q in post.items() if p not in (0, NEAR)]
    seen += [(1 << k, float(majority(START[k]))) for k in range(len(Voters.NAMES)) if not any(p >> k & 1 for p, _ in seen)]
    x, y = fired([p for p, _ in seen]), np.array([q for _, q in seen])
    u, h2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-10)
    for _ in range(rounds):
        h = (1 / (1 + np.exp(-np.clip(x @ u + BIAS, -30, 30))) - y) @ x / len(y) + 1e-3 * u
        h2 += h * h
        u -= rate * h / np.sqrt(h2)
    return u


def train(rows: list[tuple[str, int, float, float]], u: np.ndarray, rounds: int = 120, rate: float = 0.6, decay: float = 2e-4) -> np.ndarray:
    """Weights of a logistic classifier for ``(sentence, votes, label, weight)``, from the votes' weights ``u`` on; AdaGrad on the
    whole sample.

    The bias stays a cautious one: a sentence without votes and of few known runs is no abuse."""
    w = np.zeros(SLOTS + len(Voters.NAMES))
    if not rows:
        return w.astype(np.float32)
    flat, at = grams([s for s, *_ in rows])
    size = np.diff(at)
    known = fired([v for _, v, _, _ in rows]) @ u + BIAS
    y = np.array([p for _, _, p, _ in rows])
    c = np.array([q for *_, q in rows])
    c = c / c.sum()
    scale = 1 / np.sqrt(size + SHORT)
    row = np.repeat(np.arange(len(rows)), size)
    used, flat = np.unique(flat, return_inverse=True)
    v, g2 = np.zeros(len(used)), np.full(len(used), 1e-10)
    for _ in range(rounds):
        z = np.bincount(row, weights=v[flat], minlength=len(rows)) * scale + known
        r = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(flat, weights=np.repeat(r * scale, size), minlength=len(used)) + decay * v / SLOTS
        g2 += g * g
        v -= rate * g / np.sqrt(g2)
    w[used], w[SLOTS:] = v, u
    return w.astype(np.float32)


def misspelt(sentence: str, seed: int) -> str:
    """The sentence with a letter dropped, doubled, swapped or changed in about every third word, as typed in haste."""
    rng = np.random.default_rng(seed)
    out = []
    for word in sentence.split(" "):
        if len(word) > 3 and rng.random() < 0.35:
            k, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(0, 4))
            new = (word[:k] + word[k + 1 :], word[:k] + word[k] + word[k:], word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + chr(97 + int(rng.integers(0, 26))) + word[k + 1 :])
            word = new[kind]
        out.append(word)
    return " ".join(out)


def learn(rows: list[tuple[int, str, int]], post: dict[int, float]) -> np.ndarray:
    """The classifier for sentences (hash, text, votes) and the posteriors of the votes. Sentences with votes are learnt in
    misspelt forms without votes too, so that their words tell by themselves; harmless ones as well as abusive ones."""
    rows = sorted(rows)
    spoken = [r for r in rows if r[2] not in (0, NEAR)]
    made = [(s, v, post[v], 0.2 + abs(2 * post[v] - 1)) for _, s, v in spoken]
    for h, s, v in spoken:
        for other in {misspelt(s, h + k) for k in range(VARIANTS)}:
            made.append((other, 0, post[v], abs(2 * post[v] - 1)))
    # a silent sentence has the label of no evidence, so that ordinary text counts neither for nor against
    silent = [s for _, s, v in rows if v in (0, NEAR)]
    weight = SILENT * (sum(c for *_, c in made) or 1.0) / max(1, len(silent))
    made += [(s, 0, 1 / (1 + np.exp(-BIAS)), weight) for s in silent]
    return train(sorted(made), _vote_weights(post)) if rows else train([], np.zeros(0))


# What the sample holds: half sentences with votes, a quarter such with words of the lexicons but without a vote, and others.
SHARES = (0.5, 0.25, 0.25)


def _side(v: int) -> int:
    return 2 if v == 0 else 1 if v == NEAR else 0


def _votes(sample: int, docs: int):
    """For each task the counts of its vote patterns, with the sentences of the lowest hashes by ``SHARES``. They are drawn
    from documents chosen by hash, of which there are so few that all tasks together keep some hundred thousand."""
    most = 1 << 64
    below = [int(most * min(1.0, k * sample / max(1, docs))) for k in (10, 2, 0.5)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = voters_here()
        counts: Counter[int] = Counter()
        kept: tuple[dict, ...] = ({}, {}, {})
        limit = [1 << 63] * 3
        for batch in batches:
            for text in batch.column(0).to_pylist():
                of_text = xxhash.xxh64_intdigest(text)
                for s in sentences(fold(text)):
                    v = voters.vote(s)
                    counts[v] += 1
                    side = _side(v)
                    if of_text >= below[side]:
                        continue
                    h = xxhash.xxh64_intdigest(s) >> 1
                    if h < limit[side]:
                        kept[side][h] = (s, v)
                        if len(kept[side]) >= sample:
                            low = sorted(kept[side])[: sample // 2]
                            limit[side] = low[-1]
                            few = {k: kept[side][k] for k in low}
                            kept[side].clear()
                            kept[side].update(few)
        rows = [(h, s, v, 0) for side in kept for h, (s, v) in side.items()] + [(0, "", v, n) for v, n in counts.items()]
        cols = list(zip(*rows)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=["h", "s", "v", "n"])

    return run


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, dict[int, float]]:
    """Weights of the classifier, and the posteriors of the vote patterns. One pass over the documents."""
    texts = docs.select(docs[text_col].alias("t")).where("t is not null")
    seen = cut(texts.mapInArrow(_votes(sample, docs.count()), "h bigint, s string, v int, n bigint"))
    counts = {r["v"]: r["n"] for r in seen.where("n > 0").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    post = label_model(counts)
    drawn = seen.where("n = 0").select("h", "s", "v").distinct()
    sides = (~F.col("v").isin(0, NEAR), F.col("v") == NEAR, F.col("v") == 0)
    rows = [r for side, share in zip(sides, SHARES) for r in drawn.where(side).orderBy("h").limit(int(sample * share)).collect()]
    return learn([(r["h"], r["s"], r["v"]) for r in rows], post), post


def scores(docs: DataFrame, keep: list[str], w: np.ndarray, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    slim = docs.select(*keep, docs[text_col].alias("_text_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, voters = shared.value, voters_here()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            held: list[str] = []
            rows: list[int] = []

            def settle() -> None:
                if held:
                    z = 1 / (1 + np.exp(-np.clip(logits(held, [voters.vote(s) for s in held], w), -30, 30)))
                    np.maximum.at(out, rows, z)
                    held.clear()
                    rows.clear()

            size = 0
            for row, text in enumerate(batch.column(len(keep)).to_pylist()):
                if text:
                    mine = sentences(fold(text))
                    held += mine
                    rows += [row] * len(mine)
                    size += len(text)
                    if size > 500_000:
                        settle()
                        size = 0
            settle()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(out)], names=[*keep, "score"])

    return slim.mapInArrow(run, f"{fields}, score double")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of each document."""
    docs = table(spark, folder, "documents")
    return scores(docs, ["doc_id", "source"], fit(docs)[0]).select("doc_id", "source", F.round("score", 6).alias("score"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that count as abusive."""
    return p8_scores(spark, folder).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, abusive ones among them and their rate per source."""
    hit = (F.col("score") >= THRESHOLD).cast("int")
    rated = p8_scores(spark, folder).groupBy("source").agg(F.count("*").alias("docs"), F.sum(hit).alias("abusive"), F.round(F.avg("score"), 6).alias("mean_score"))
    return rated.withColumn("rate", F.col("abusive") / F.col("docs"))


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
