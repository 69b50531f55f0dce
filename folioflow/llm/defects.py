"""Finding broken prompt and response pairs and naming the defect.

A multi-label linear classifier looks at hashed n-grams of the response and at
features of the pair. It is trained on responses that are made broken on
purpose: cut short, copied from the prompt, swapped for a refusal or for a text
in another language, or emptied; answers swapped between prompts stay without a
defect, so that the classifier doesn't learn to judge the topic. The responses
as they came are taken as sound in the first round; those that the first round
finds broken are left out (or join the broken ones) in the second. The
thresholds are calibrated on responses held back from the training. The first
round sees no words, only the features of the pair, so that it can't learn by
heart which words the broken responses among the presumed sound ones have.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("empty", "truncated", "refusal", "copy", "other_language")
DIMS = 1 << 15
#: The bound on labelled rows: pairs that the training set is made from, chosen by a hash of the id.
TRAIN_ROWS = 5000
SHARE_HELD_BACK = 0.2

# Labels that models put before an answer.
_LABEL = re.compile(
    r"^[\s\W_]*(?:<\s*summary\s*>|(?:here(?:'s| is| comes)(?: the| a| your)?(?: short| brief| one-sentence)? (?:summary|tl;?dr|answer)|tl\s*;?\s*dr|summary|abstract|in short|answer|response|announce type:? new\s+abstract)\b\**\s*[:\-–.]*)[\s*_>\-:]*",
    re.I,
)
_CLOSE = re.compile(r"<\s*/\s*summary\s*>\s*$", re.I)
# What stands for no answer.
_NOTHING = frozenset(["", "null", "none", "na", "nan", "nil", "nosummary", "noanswer", "empty", "tbd", "todo", "undefined", "summary", "tldr", "abstract", "answer", "unknown"])
# Frequent small words of English and of other languages.
_ENGLISH = frozenset("the of and to in is for that on with by as at from this are be it we can how when which an or not than its was has have does no but over under a".split())
_OTHER = frozenset(
    "der die das und ist ein eine einer für mit auf von dem den des im nicht auch sich bei sind wird werden zur zum durch gegenüber ohne dass wir "
    "le la les des du une et est dans pour par sur avec que qui se ne pas en au aux sans nous cet cette ont été d l "
    "el los las un una y es por con para del al se sin son este esta todavía frente en de "
    "o os as um uma e do da dos das em no na nos nas por para com não é são ao à ainda se que "
    "il di che è per con una nel della een het van voor niet en zijn op aan".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,]*\d|\d")
_PLAIN = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_QUOTED = re.compile(r"[\"“„][^\"”“]{0,200}[\"”“]")
_SELF = re.compile(r"(?i:(?<![\w'’.-])(?:me|my|i['’](?:m|d|ll|ve)|sorry|apologies|apologi[sz]e)(?![\w-]))|(?<![\w.'’-])I(?![\w.-])")
_JOINING = frozenset("a an the of and or to in is are for that on with by as at from this which how when can be has have its their both than not no into over under works makes makes".split())

# The parts that refusals are put together from at random: {v} a verb, {g} its gerund, {o} what was asked for, {x} a kind of text, {t} the topic, {y} too little.
_SORRY = (
    "", "", "", "", "Sorry to say,", "Sorry but", "So sorry:", "Apologies, though", "My apologies, but", "I do apologise;", "Unfortunately", "Regrettably", "Alas,", "I fear", "Thank you, but", "Thanks for the {x}, but",
    "As an assistant", "As an AI model", "Being an AI", "Being a language model", "To be honest,", "Before anything else:", "Of course, yet", "Well,",
)
_CLAUSE = (
    "I cannot {v} {o}", "I can't {v} {o}", "I can not {v} {o} here", "I am not able to {v} {o}", "I'm unable to {v} {o}", "I am unable to {v} any {x}", "I was unable to {v} {o}", "I could not {v} {o}", "I will not {v} {o}",
    "I won't {v} {o}", "I would rather not {v} {o}", "I'd rather not {v} the {x}", "I must decline to {v} {o}", "I have to decline {o}", "I decline to {v} {o}", "I do not {v} {o}", "I don't {v} such a {x}",
    "I have to pass on {o}", "I have no access to {o}", "I do not have the {x} itself", "I don't have the information to {v} {o}", "I do not have enough of it to {v} {o}", "I would need more of the {x} to {v} {o}",
    "I'd need the {x} in full to {v} it", "I can't say anything of {t}", "it isn't possible for me to {v} {o}", "it is not something I can {v}", "it would not be right for me to {v} {o}", "it would be inappropriate to {v} {o}",
    "this is outside of what I can {v}", "this is beyond what I am able to {v}", "there was no {x} provided that I could {v}", "no {x} was given, so there is nothing to {v}", "the {x} seems to be missing, so I can't {v} it",
    "nothing was provided that can be summarised", "the {x} is missing, and I will not invent one", "guidelines that I follow do not let me {v} {o}", "my policy does not permit me to {v} {o}", "answering would violate the usage guidelines",
    "can't {v} {o}", "cannot {v} it", "won't {v} {o}", "unable to {v} {o}", "{g} {o} isn't possible for me", "{g} {o} is not possible here", "{g} things like {t} isn't what I do", "I'd need more than {y} to {v} {o}", "I would need more than {y} for {t}",
    "{y} is not enough for me to {v} {o}", "with {y} only I can't tell anything about {t}", "there is nothing that I could {v} here", "requests like these are against my policy", "studies of {t} are a thing I can't {v}", "work on {t} is something I must decline to {v}", "please note that I can't {v} {o}", "I refuse to {v} {o}", "I'm afraid that I can't {v} {o}",
)
_VERB = ("answer", "summarise", "summarize", "describe", "provide", "discuss", "condense", "comment on", "write", "produce", "help with", "assist with", "comply with", "process", "speculate about", "generate", "do", "access", "give an account of")
_DOING = ("answering", "summarising", "describing", "providing", "condensing", "writing", "producing", "judging", "reviewing", "giving", "discussing")
_LITTLE = ("this", "a heading", "a few words", "the name of it", "a title", "so little", "what is here", "one line")
_ASKED = (
    "any of this", "a question of this kind", "questions like that", "the {x} in question", "this {x} of yours", "the content of such a {x}", "a summary for it", "a TLDR of the {x}", "any summary here", "what you request", "that sort of request",
    "the work on {t}", "matters of {t}", "material about {t}", "this particular one", "one for this item", "this prompt", "that",
)
_BRIEF = (
    "Declined: the {x} is restricted", "Refused", "Withheld", "No reply: blocked by a safety filter", "Answer filtered", "Output blocked", "Summary withheld for safety", "The assistant refused", "The model declined to answer it",
    "Response filtered: restricted content", "Unable to answer", "Cannot comply", "Request refused", "No summary generated", "Summary not available: the model declined", "Filtered by policy", "Sorry, no", "Sorry!",
)
_CLOSING = ("", "", "", "", " just now", " at present", "; ask the authors instead, please", ". Please send the complete text", ". Do paste the full {x} and ask once more", ". I can help with other things", ". Please try later on")
_KIND = ("paper", "abstract", "document", "manuscript", "text", "article", "input")


def refusal(topic: str, rng: random.Random) -> str:
    """A refusal made by the grammar above."""
    fill = {"t": topic, "x": rng.choice(_KIND)}
    if rng.random() < 0.15:
        said = rng.choice(_BRIEF).format(**fill)
        return rng.choice(("{}.", "{}", "[{}]", "({})")).format(said)
    said = rng.choice(_CLAUSE).format(v=rng.choice(_VERB), g=rng.choice(_DOING), y=rng.choice(_LITTLE), o=rng.choice(_ASKED).format(**fill), **fill)
    start = rng.choice(_SORRY).format(**fill)
    return (f"{start} {said}" if start else said[0].upper() + said[1:]) + rng.choice(_CLOSING).format(**fill) + "."


# Sentences in other languages, so that a sample without any still teaches what they look like.
_STRANGE = (
    "Die Methode kommt ohne zusätzliche Daten aus, und der Fehler sinkt deutlich. Die Grenzen werden am Ende besprochen.",
    "Cette étude présente une méthode qui se passe de données supplémentaires. Les limites sont discutées à la fin.",
    "Este trabajo propone un método que no necesita datos adicionales. El error se reduce de forma clara.",
    "Este artigo apresenta um método que não precisa de dados adicionais. O erro diminui de forma clara.",
    "Questo lavoro presenta un metodo che non ha bisogno di altri dati. Alla fine si discutono i limiti.",
    "В работе предложен метод, который не требует дополнительных данных. В заключение обсуждаются его ограничения.",
    "本文提出一种无需额外数据的方法，误差明显降低。最后讨论了该方法的局限。",
    "本論文では追加のデータを必要としない手法を提案する。最後に手法の限界について論じる。",
    "본 논문에서는 추가 데이터가 필요 없는 방법을 제안한다. 마지막으로 한계를 논의한다.",
    "تقدم هذه الدراسة طريقة لا تحتاج إلى بيانات إضافية. وتناقش في النهاية حدودها.",
)


def core(response: str) -> str:
    """The response without labels around it."""
    text = response.replace("​", "").replace("﻿", "").strip()
    for _ in range(3):
        cut = _LABEL.sub("", text, count=1)
        if cut == text:
            break
        text = cut
    return _CLOSE.sub("", text).strip()


def _letters(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _PLAIN.sub("", text)


def _grams(s: str, n: int = 6) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def copied_share(body: str, prompt: str | None) -> float:
    """The smallest share, over the response's sentences, of letter sequences that the prompt has too."""
    source = _letters(prompt or "")
    if not source:
        return 0.0
    least, grams, whole = 1.0, None, _letters(body)
    if len(whole) < 20:
        return 0.0
    if whole in source:
        return 1.0
    for sentence in _SENTENCE.split(body):
        s = _letters(sentence)
        if len(s) < 12 or s in source:
            continue
        if not any(s[i : i + 8] in source for i in range(0, len(s) - 7, max(1, len(s) // 9))):
            return 0.0
        grams = _grams(source) if grams is None else grams
        own = _grams(s)
        least = min(least, len(own & grams) / max(1, len(own)))
    return least


def _words(text: str) -> list[str]:
    """Words in lower case; every number is the same word."""
    return ["9" if w[0].isdigit() else w.lower() for w in _WORD.findall(text)]


def _hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text) & (DIMS - 1)


def features(title: str | None, prompt: str | None, response: str, known: frozenset[int] = frozenset(), lexical: bool = True) -> list[int]:
    """The hashed features of a pair.

    known: hashes of the words that sound responses end with ahead of their
    full stop. lexical: whether n-grams are among the features.
    """
    body = core(response)
    out = ["bias"]
    letters = _letters(body)
    n = len(letters)
    out.append(f"size {min(12, n.bit_length())}")
    if n == 0 or letters in _NOTHING:
        return [_hash(f) for f in (*out, "nothing")]
    low = _words(body)
    foreign = 0.0 if letters.isascii() else sum(1 for c in letters if c > "\u024f") / n
    english = sum(w in _ENGLISH for w in low) / max(1, len(low))
    other = sum(w in _OTHER and w not in _ENGLISH for w in low) / max(1, len(low))
    out += [f"foreign {int(foreign * 5)}", f"english {min(6, int(english * 20))}", f"other {min(6, int(other * 20))}", f"lead {(other > english) + (other > 2 * english)}"]
    if other > english and english < 0.06:
        out.append("speaks other")
    if foreign > 0.3:
        out.append("writes other")

    share = copied_share(body, prompt or "")
    out.append(f"copied {int(share * 20)}")
    for at in (0.7, 0.8, 0.88, 0.95):
        if share >= at:
            out.append(f"copied from {at}")

    tail = body.rstrip("*_ \n\t")
    bare = tail.rstrip("\"'”’»)]}")
    ends = bare[-1:] in tuple(".!?。！？") and not tail.endswith(("...", "…"))
    out.append("ends" if ends else "open end")
    last, two = (low[-1] if low else ""), " ".join(low[-2:])
    if not ends:
        context = set(_WORD.findall(f"{title or ''} {prompt or ''}".lower()))
        parts = {p for w in context for p in w.split("-")} | context
        if tail.endswith(("...", "…")):
            out.append("ends in dots")
        elif tail[-1:] in "-–—,;:(/":
            out.append("ends in joint")
        elif not tail[-1:].isalnum():
            out.append("ends in mark " + tail[-1:])
        if last in _JOINING:
            out.append("ends in joining word")
        seen = _hash("end " + last) in known
        out.append("end seen" if seen else "end unseen")
        out.append("end two seen" if _hash("ends " + two) in known else "end two unseen")
        if not seen and last not in parts:
            out.append("ends in no word")
            if any(p.startswith(last) for p in parts):
                out.append("ends in part of a word")
    for a, b in (("(", ")"), ("[", "]"), ("“", "”")):
        if body.count(a) > body.count(b):
            out.append("unclosed " + a)
    if body.count('"') % 2:
        out.append("unclosed quote")
    if _SELF.search(_QUOTED.sub(" ", body)):
        out.append("speaks of itself")
    if len(low) < 4:
        out.append("few words")
    if lexical:
        out += ["end " + last, "ends " + two] if not ends else ["closed " + last]
        out += ["w " + w for w in low]
        out += [f"b {x} {y}" for x, y in zip(low, low[1:])]
        out += ["first " + low[0] if low else "first", "start " + " ".join(low[:2]), "begin " + " ".join(low[:3])]
    return [_hash(f) for f in set(out)]


class Model:
    """Weights and bias by label, thresholds, and the endings that sound responses have."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, known: frozenset[int]):
        self.weights, self.thresholds, self.known = weights.astype(np.float32), thresholds, known

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities, a row for each list of features, a column for each label."""
        if not rows:
            return np.zeros((0, len(LABELS)))
        at = np.cumsum([0] + [len(r) for r in rows[:-1]])
        sums = np.add.reduceat(self.weights[np.concatenate(rows)], at, axis=0)
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))

    def defects(self, pairs: list[tuple[str | None, str | None, str]]) -> list[str | None]:
        """The defect that exceeds its threshold the most, or None."""
        p = np.clip(self.scores([features(*x, known=self.known) for x in pairs]).astype(np.float64), 1e-9, 1 - 1e-9)
        over = np.log(p / (1 - p)) - np.log(self.thresholds / (1 - self.thresholds))
        best = over.argmax(axis=1) if len(p) else []
        return [LABELS[b] if over[i, b] >= 0 else None for i, b in enumerate(best)]


def broken(pairs: list[tuple[str | None, str | None, str]], rng: random.Random) -> list[tuple[tuple[str | None, str | None, str], set[str]]]:
    """Pairs made from sound ones, with the defects they were given; the sound ones stay among them."""
    out: list[tuple[tuple[str | None, str | None, str], set[str]]] = []
    strange = [s for _, x, _ in pairs if x for s in [x] if _is_foreign(s)]
    strange += list(_STRANGE) * (1 + len(strange) // 40)
    prompts = [x for _, x, _ in pairs if x and not _is_foreign(x) and len(x) > 150]
    labels = ("", "", "", "TL;DR: ", "Summary: ", "**Summary:** ", "In short: ", "TLDR - ", "Here is the summary:\n\n")
    for t, x, r in pairs:
        out.append(((t, x, r), set()))
        stopless = r.rstrip().rstrip(".")
        if rng.random() < 0.3 and stopless and stopless[-1].isalnum():
            out.append(((t, x, stopless), set()))
        other = rng.choice(pairs)
        if rng.random() < 0.5:  # swapped between prompts
            out.append(((other[0], other[1], r), set()))
        for _ in range(2):
            at = int(len(r) * rng.uniform(0.3, 0.93))
            cut = r[:at].rstrip() if rng.random() < 0.5 else r[:at].rpartition(" ")[0].rstrip()
            if len(cut) > 15 and not cut.endswith((".", "!", "?")):
                out.append(((t, x, cut + rng.choice(("", "", "", "", "...", "…", " -", ",", " (", ";", " and", " which", " the", ":"))), {"truncated"}))
        said = x if x and not _is_foreign(x) and len(x) > 80 else None
        if said is None and prompts:
            said = rng.choice(prompts)
        if said and rng.random() < 0.8:
            sentences = [s for s in _SENTENCE.split(said) if s.strip()]
            k = rng.randint(1, len(sentences))
            take = " ".join(sorted(rng.sample(sentences, k), key=sentences.index)) if rng.random() < 0.7 else said
            style = rng.random()
            if style < 0.15:
                take = take.lower()
            elif style < 0.3:
                take = take.upper()
            elif style < 0.45:
                take = re.sub(r"[^\w\s-]", "", take)
            elif style < 0.65:
                letters = list(take)
                for _ in range(max(1, len(letters) // 90)):
                    i = rng.randrange(len(letters) - 1)
                    letters[i], letters[i + 1] = letters[i + 1], letters[i]
                take = "".join(letters)
            out.append(((t, said, rng.choice(labels) + take), {"copy"}))
        topic = " ".join((t or "this work").split()[-4:-1]).lower()
        if rng.random() < 0.6:
            text = refusal(topic, rng)
            out.append(((t, x, text), {"refusal"}))
        if strange and rng.random() < 0.5:
            sentences = [s for s in _SENTENCE.split(re.sub(r"^\s*announce type[^\n]*\n\s*(?:abstract:)?", "", rng.choice(strange), flags=re.I)) if s.strip()]
            text = " ".join(rng.sample(sentences, min(len(sentences), rng.randint(1, 3))))
            if rng.random() < 0.3:  # terms of the field stay English in texts of any language
                words = text.split(" ")
                at = rng.randrange(len(words))
                text = " ".join([*words[:at], *topic.split()[:2], *words[at:]])
            if _is_foreign(text):
                out.append(((t, x if x and not _is_foreign(x) else None, rng.choice(labels) + text), {"other_language"}))
        if rng.random() < 0.15:
            text = rng.choice(("", " ", "\n", "...", "-", "N/A", "null", "none", "[]", '""', "<summary></summary>", "​", "\xa0"))
            out.append(((t, x, rng.choice(labels) + text if rng.random() < 0.5 else text), {"empty"}))
    return out


def _is_foreign(text: str) -> bool:
    text = re.sub(r"^\s*announce type[^\n]*\n\s*(?:abstract:)?", "", text, flags=re.I)
    letters = [c for c in text if c.isalpha()]
    if len(letters) < 12:
        return False
    if sum(c > "ɏ" for c in letters) > 0.3 * len(letters):
        return True
    low = [w.lower() for w in _WORD.findall(text)]
    english = sum(w in _ENGLISH for w in low)
    return sum(w in _OTHER and w not in _ENGLISH for w in low) > 1.5 * english and english < 0.08 * len(low)


def _learn(rows: list[list[int]], wanted: np.ndarray, rng: np.random.Generator, passes: int = 10, size: int = 1024, rate: float = 0.1, decay: float = 3e-6) -> np.ndarray:
    """Logistic regression for every label at once, by Adam on mini-batches."""
    labels = wanted.shape[1]
    lengths = np.array([len(r) for r in rows])
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    used, places = np.unique(np.concatenate([np.array(r, np.int64) for r in rows]), return_inverse=True)  # features that occur
    w = np.zeros((len(used), labels), np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(max(passes, 400 * size // max(size, len(rows)))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), size):
            ids = order[lo : lo + size]
            n = lengths[ids]
            begins = np.r_[0, np.cumsum(n)[:-1]]
            flat = places[np.repeat(starts[ids] - begins, n) + np.arange(n.sum())]
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], begins, axis=0), -30, 30)))
            error = np.repeat((p - wanted[ids]) / len(ids), n, axis=0)
            cells = (flat[:, None] * labels + np.arange(labels)).ravel()
            g = decay * w + np.bincount(cells, weights=error.ravel(), minlength=w.size).reshape(w.shape).astype(np.float32)
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    whole = np.zeros((DIMS, labels), np.float32)
    whole[used] = w
    w = whole
    return w


def _calibrated(p: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each label the threshold with the best F1 on held-back pairs, weighted as they occur."""
    best = np.full(p.shape[1], 0.5)
    for k in range(p.shape[1]):
        tried = np.unique(np.r_[0.5, np.quantile(p[:, k], np.linspace(0.5, 1, 200))])
        scores = []
        for t in tried:
            hit = p[:, k] >= t
            good = (weight * (hit & (wanted[:, k] > 0))).sum()
            scores.append(2 * good / max(1e-9, (weight * hit).sum() + (weight * wanted[:, k]).sum()))
        top = np.flatnonzero(np.array(scores) >= max(scores) - 1e-9)
        best[k] = float(np.median(tried[top]))
    return best


def train(pairs: list[tuple[str | None, str | None, str]], seed: int = 11) -> Model:
    """A model from responses most of which are sound. No pairs at all: a model that is made from stock phrases."""
    rng, steps = random.Random(seed), np.random.default_rng(seed)
    if not pairs:
        pairs = [("On the work", "We study the work in the field. It is of use to the reader and has no bounds.", "Shows that the work is of use.")]
    # Endings are learned from other responses than the classifier is.
    half = (len(pairs) + 1) // 2
    known = frozenset(h for r in pairs[:half] for h in _endings(r[2]))
    told = pairs[half:] or pairs
    clean, found, model = told, [], None
    for lexical in (False, True):
        made = broken(clean, rng) + found
        rng.shuffle(made)
        rows = [features(*x, known=known, lexical=lexical) for x, _ in made]
        wanted = np.array([[float(k in d) for k in LABELS] for _, d in made])
        held = max(1, int(len(made) * SHARE_HELD_BACK)) if lexical and len(made) > 50 else 0
        weights = _learn(rows[held:], wanted[held:], steps)
        model = Model(weights, np.full(len(LABELS), 0.5), known)
        p = model.scores([features(*x, known=known, lexical=lexical) for x in told])
        if not lexical:
            clean = [x for x, q in zip(told, p) if q.max() < 0.5] or told
            found = [(x, {LABELS[q.argmax()]}) for x, q in zip(told, p) if q.max() > 0.9]
        elif held:
            prior = (p >= 0.5).mean(axis=0) + 1e-3  # how often each defect seems to occur
            share = wanted[:held].mean(axis=0) + 1e-9
            sound = wanted[:held].sum(axis=1) == 0
            weight = np.where(sound, max(0.1, 1 - prior.sum()) / max(1e-9, sound.mean()), (wanted[:held] * (prior / share)).sum(axis=1))
            model.thresholds = _calibrated(model.scores(rows[:held]), wanted[:held], weight)
    assert model is not None
    return model


def _endings(response: str) -> list[int]:
    """Hashes of the last word and the last two, of a response that ends in a full stop."""
    text = core(response)
    if not text.endswith(".") or text.endswith(".."):
        return []
    low = _words(text)
    return [_hash("end " + w) for w in low[-1:]] + [_hash("ends " + " ".join(low[-2:]))]


def sample(df: DataFrame, rows: int) -> list[tuple[str | None, str | None, str]]:
    """At most `rows` pairs, those with the smallest hashes of their ids; the bound is the parameter.

    A share of the rows that is a little larger than needed is kept by hash
    first, so that not every partition sends its own candidates.
    """
    asked = df.where("response is not null").select("title", "prompt", "response", F.xxhash64("id").alias("h"), "id")
    n = asked.count()
    if n > 2 * rows:
        most = int((1 << 63) * (2 * 1.2 * rows / n) - (1 << 63))
        asked = asked.where(F.col("h") < most)
    return [(r.title, r.prompt, r.response) for r in asked.orderBy("h", "id").limit(rows).collect()]


def flag(df: DataFrame, model: Model) -> DataFrame:
    """id and defect of the broken pairs. df: id, title, prompt, response.

    A null response is not asked for and no case. An empty or blank response,
    or a mark or label without an answer, is `empty`; null titles and prompts
    are taken as empty texts. Repeated rows come out as often as they are in df.
    Responses and prompts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, titles, prompts, responses = (c.to_pylist() for c in batch.columns)
            found = model.defects(list(zip(titles, prompts, responses)))
            keep = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.string())], names=["id", "defect"])

    asked = df.where("response is not null").select(F.col("id").cast("long"), "title", "prompt", "response")
    return asked.mapInArrow(run, "id long, defect string")


def find_defects(df: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """flag() with a model trained on a bounded sample of df itself."""
    return flag(df, train(sample(df, train_rows)))
