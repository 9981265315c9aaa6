"""Defective answers of prompt and response pairs.

For every defect several noisy labelling functions vote on a pair; an expectation
maximisation label model (labelmodel) weighs them without labels, and each defect whose
posterior reaches its cutoff is kept, so a pair may have several. Some functions use
statistics of the whole table: how often a phrase ends a sentence, how often a whole
answer recurs, and letter trigrams per language.

Defects: empty, truncated, refusal, copy, other_language. A preview cut after 400
characters (then "...") is no defect.

Defined results: a null response is empty; a blank or null prompt is no defect, cannot be
copied and has no language; rows with null id are left out; an id counts once however
often its row comes; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circuitlake.llm import labelmodel
from circuitlake.runtime import cut, small

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
#: Posterior cutoffs; tests/llm checks them on hand-made cases of every kind.
CUTOFFS = {d: 0.5 for d in DEFECTS}
PREVIEW = 400
BUCKETS = 1 << 14

# Function words by language (closed classes), used to tell languages apart.
FUNCTION_WORDS = {
    "en": "the a an is are was were be been of to and in on at for with by from that this it its as not you your i my me we can cannot will would should if when which what how why do does did but or so than then then about only use after before",
    "de": "der die das den dem des ein eine einen einem einer ist sind war wird werden wurde wurden und oder nicht mit für von zu zum zur auf aus bei nach ich mir mich wir sie es dass wie warum wenn ob am im an als auch kann kein keine nur diese dieser leider bitte",
    "fr": "le la les un une des du de et est sont était que qui dans sur pour avec par ne pas plus ce cette ces je nous vous il elle au aux à en dès si sous mon ma se puis tout tous donc comment pourquoi quand",
    "es": "el la los las un una unos de del y es son era que en sobre para con por no más se su sus al lo como cuando si hasta después qué cómo cuál porque puedo debo esta este esto me mi le así hace falta",
    "tr": "bir bu ve ile için de da ne nasıl neden çok daha olan olarak değil ki mi mı gibi kadar sonra önce ise bütün üzerine altına göre ben bana benim şu var yok",
    "it": "il lo gli una di che è sono non con per della delle nel nella dal come quando se più questo questa anche",
    "pt": "o os uma de que não com para do da dos das no na em se mais como quando por são ser este esta também",
    "nl": "het een van en is zijn niet met voor op aan dat die deze als ook maar naar door wordt bij hoe waarom kan",
}
_LETTERS = {"tr": "ışğİ", "de": "ßä", "es": "ñ¿¡", "fr": "çœêèùâî"}
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles ingilizce inglese", "de": "german deutsch allemand alemán aleman almanca tedesco",
    "fr": "french französisch français francais francés frances fransızca fransizca francese", "es": "spanish spanisch espagnol español espanol castellano ispanyolca spagnolo",
    "tr": "turkish türkisch turc turco türkçe turkce", "it": "italian italienisch italien italiano italyanca",
    "pt": "portuguese portugiesisch portugais portugués portugues português portekizce", "nl": "dutch niederländisch néerlandais holandés felemenkçe",
}

_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_NAMES = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
LANGS = tuple(FUNCTION_WORDS)

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_PLACEHOLDER = re.compile(
    r"[\W_]*(?:n\W?a|none|null|nil|nan|undefined|empty|blank|tbd|no (?:output|answer|response|content|data|reply)|(?:output|answer|response) (?:empty|missing)|<?\|?(?:end|eos|eot|endoftext|im_end|pad|s)\|?>?)?[\W_]*", re.I
)
_ME = r"(?:i|we|this assistant|the assistant)"
_INABILITY = re.compile(
    rf"\b{_ME}(?:'m| am| are| is)? (?:really |simply |just )?(?:(?:can ?not|can't|won't|will not|would not|wouldn't|could not|couldn't|shouldn't|do not|don't|may not|must not)\b|(?:unable|not able|not permitted|not allowed|not going|not in a position|not comfortable)\b|(?:must|have to|need to|prefer to) (?:decline|refuse|pass|abstain|refrain)|decline\b|refuse\b|'d rather not|would rather not)"
    r"|\bi'd rather not\b|\brefuse to\b|\b(?:so i won't|i will leave this here|i won't be able)\b|\b(?:do not|does not|don't) allow me\b|\bnot something i can\b|\boutside (?:of )?what i\b|\brequest i cannot\b|\bbeyond my (?:role|scope|remit)\b"
    r"|\b(?:ich kann|kann ich)\b.*\bnicht\b|\bich (?:darf|möchte|will|werde)\b.*\bnicht\b|\bich lehne\b"
    r"|\bno (?:puedo|podemos|debo)\b|\bno me es posible\b|\bno estoy autorizad"
    r"|\bje ne (?:peux|pourrai|suis|souhaite|veux)\b.*\bpas\b|\bje ne peux\b|\bimpossible de (?:vous )?(?:répondre|aider)|\bje refuse\b"
    r"|\byardımcı olamam\b|\byanıtlayamam\b|\bcevap veremem\b|\byapamam\b|\b(?:yanıtlamam|cevaplamam|yardım etmem) mümkün değil\b", re.I,
)
_APOLOGY = re.compile(r"\bi(?:'m| am) (?:very |so )?sorry\b|^sorry[,.]|\bunfortunately\b|\bregrettably\b|\bapologi[sz]e\b|\bafraid\b|\bleider\b|\btut mir leid\b|\blo siento\b|\blamentablemente\b|\bdésolée?\b|\bmalheureusement\b|\bregrette\b|\büzgünüm\b|\bmaalesef\b", re.I)
_META = re.compile(r"\blanguage model\b|\bassistant\b|\bguidelines?\b|\bpolic(?:y|ies)\b|\brules i\b|\bmy role\b|\bpermitted\b|\bdesign advice\b|\bsuch questions\b|\bthis (?:topic|question|request)\b|\bthat request\b|\bas an ai\b|\bdemande\b|\bpetición\b|\bpregunta\b|\banfrage\b|\bdabei\b|\bsoruyu\b|\bkonuda\b|\binstructions i\b|\birresponsible of me\b", re.I)
_REDIRECT = re.compile(r"\bsomething else\b|\bplease (?:ask|consult|contact)\b|\bqualified\b|\btalk about\b|\badvise you\b|\bno, i will not\b|\bi will not do\b|\bpass on this\b|\banswer(?:ing)? (?:that|this)\b", re.I)
_DANGLING = re.compile(r"[,:;(\[{=+/<&\-–—]\s*$")
_TERMINAL = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*\s*$")
_UNITY = r"(?:[munpfkgtµμ]?(?:v|a|s|hz|f|w|h|ohms?|ω|s)|meg|mohm|mhz|ghz|db[mc]?|deg|degrees?|°c?|°|um|nm|mm|k|c|u|n|p|f|m|g|percent|%)"
_QUANTITY = re.compile(rf"(?<![\w.])[+-]?\d+(?:[.,]\d+)*(?:e[+-]?\d+)?(?:\s?{_UNITY}(?![\w]))", re.I)
_PLAIN = re.compile(r"(?<![^\W\d_])[+-]?\d+(?:[.,]\d+)*(?:e[+-]?\d+)?", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:[._'][^\W_]+)*|qqu|qqn", re.U)


def plain(text: str | None) -> str:
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text or ""))


def folded(text: str) -> list[str]:
    """Words without case and marks."""
    t = unicodedata.normalize("NFKD", text.casefold())
    return _WORD.findall("".join(c for c in t if not unicodedata.combining(c)).replace("ı", "i"))


def is_cut(response: str) -> bool:
    """Whether the preview limit cut the response."""
    return response.endswith("...") and len(response) > PREVIEW - 5


def shape(text: str) -> list[str]:
    """Tokens with quantities and numbers folded."""
    t = _PLAIN.sub(" qqn ", _QUANTITY.sub(" qqu ", text.lower()))
    return _TOKEN.findall(t)


def phrases(text: str) -> list[tuple[list[str], bool]]:
    """(tokens, terminated) of each sentence outside code fences."""
    out = []
    for part in re.split(r"```[^`]*(?:```|$)", text):
        for s in re.split(r"(?<=[.!?…])[\"'”’»)\]*_]*\s+|\n+", part):
            s = re.sub(r"^\s*(?:\d+[.)]|[-*•])\s+", "", s)
            tokens = shape(s)
            if tokens:
                out.append((tokens, bool(_TERMINAL.search(s))))
    return out


def _key(tokens: list[str]) -> int:
    """A 64-bit key of tokens, as a signed number."""
    return xxhash.xxh64_intdigest(" ".join(tokens)) - (1 << 63)


TAILS = (6, 5, 4, 3, 2)


def count_endings(text: str, ends: Counter, mids: Counter) -> None:
    """Count the n-grams that end a terminated sentence and those that go on."""
    for tokens, terminated in phrases(text[:-3] if is_cut(text) else text):
        padded = ["^"] + tokens
        for i in range(1, len(padded)):
            last = i == len(padded) - 1
            if last and not terminated:
                continue
            for n in TAILS:
                if i + 1 >= n:
                    (ends if last else mids)[_key(padded[i + 1 - n : i + 1])] += 1


def by_words(words: list[str]) -> str | None:
    """Language by function words; None when undecided."""
    votes = {lang: sum(w in s for w in words) for lang, s in _SETS.items()}
    best = max(votes, key=votes.get)
    rest = max(v for lang, v in votes.items() if lang != best)
    return best if votes[best] and votes[best] > rest else None


def by_letters(text: str) -> str | None:
    seen = {lang: sum(text.count(c) for c in chars) for lang, chars in _LETTERS.items()}
    best = max(seen, key=seen.get)
    return best if seen[best] > sum(seen.values()) / 2 else None


def trigrams(text: str) -> np.ndarray:
    t = " ".join(w for w in _WORD.findall(text.lower()) if not any(c.isdigit() for c in w))
    t = f" {t} "
    return np.array([zlib.crc32(t[i : i + 3].encode()) % BUCKETS for i in range(len(t) - 2)] if len(t) > 4 else [], np.int64)


def _prose(text: str) -> str:
    return re.sub(r"```[^`]*(?:```|$)", " ", text)


class Trigrams:
    """Naive Bayes over hashed letter trigrams, learned from the table's own texts."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)  # a language of few texts is smoothed towards no language
        self.logs = [np.log((counts[lang] + 0.1) / (counts[lang].sum() + 0.1 * BUCKETS)) for lang in self.langs]

    def __call__(self, text: str) -> str | None:
        ids = trigrams(text)
        if len(ids) < 8 or not self.langs:
            return None
        scores = sorted(((float(log[ids].sum()), lang) for log, lang in zip(self.logs, self.langs, strict=True)), reverse=True)
        return scores[0][1] if len(scores) == 1 or scores[0][0] - scores[1][0] > 3.0 else None


def language(text: str, model: Trigrams) -> list[str | None]:
    """Opinions of the three language functions."""
    prose = _prose(text)
    words = [w for w in _WORD.findall(prose.lower()) if not any(c.isdigit() for c in w)]
    return [by_words(words), by_letters(prose), model(prose)]


def requested(prompt: str) -> set[str]:
    """Languages named in the prompt."""
    return {_NAMES[w] for w in _WORD.findall(prompt.lower()) if w in _NAMES}


def without_prompt(response: list[str], prompt: list[str]) -> tuple[list[str], int, int]:
    """(words left after taking out all copies of the prompt, copies, words before the first copy).

    A prompt of one or two words may stand in any answer; it counts as copied only if the
    answer is nothing but copies of it.
    """
    if not prompt or len(prompt) < 3 and response != prompt * (len(response) // len(prompt)):
        return response, 0, 0
    left, copies, before, i = [], 0, 0, 0
    while i < len(response):
        if response[i : i + len(prompt)] == prompt:
            before = before if copies else len(left)
            copies += 1
            i += len(prompt)
        else:
            left.append(response[i])
            i += 1
    return left, copies, before


def tail_key(response: str) -> list[str] | None:
    """Tokens of the last sentence if it stops without an end mark; None otherwise."""
    if is_cut(response) or response.count("```") % 2 or response.rstrip().endswith("```") or _TERMINAL.search(response):
        return None
    got = phrases(response)
    return got[-1][0] if got else None


# Labelling functions per defect with the prior chance that they vote +1, if they vote, on a clean and on a defective pair.
FUNCTIONS = {
    "empty": {"no_words": (0.01, 0.90), "placeholder": (0.01, 0.95)},
    "truncated": {"open_fence": (0.005, 0.25), "dangling": (0.005, 0.15), "no_end_mark": (0.08, 0.99), "tail": (0.02, 0.97), "new_form": (0.30, 0.99)},
    "refusal": {"inability": (0.005, 0.85), "apology": (0.005, 0.40), "meta": (0.01, 0.60), "redirect": (0.005, 0.30), "no_numbers": (0.06, 0.90)},
    "copy": {"only_prompt": (0.005, 0.95), "covered": (0.01, 0.95), "letters": (0.01, 0.94)},
    "other_language": {"function_words": (0.01, 0.96), "letters": (0.02, 0.95), "trigrams": (0.01, 0.96)},
}
SHARES = {"empty": 0.04, "truncated": 0.06, "refusal": 0.05, "copy": 0.04, "other_language": 0.05}


def _sign(x: bool | None) -> int:
    return 0 if x is None else 1 if x else -1


def votes(prompt_text: str | None, response_text: str | None, tail: float | None, tail_seen: int, form_share: float, model: Trigrams) -> dict[str, list[int]]:
    """Votes of every labelling function, in the order of FUNCTIONS.

    tail: share of the tail's occurrences that end a sentence; tail_seen: occurrences;
    form_share: share of all prompts to which some response of this shape was given.
    """
    prompt, response = plain(prompt_text), plain(response_text)
    words = folded(response)
    out: dict[str, list[int]] = {}
    holder = _PLACEHOLDER.fullmatch(response) is not None
    out["empty"] = [_sign(None if 0 < len(words) < 4 else not words), _sign(holder)]

    cut_off, fences = is_cut(response), response.count("```")
    ends = bool(_TERMINAL.search(response)) or fences and fences % 2 == 0 and response.rstrip().endswith("```")
    prompt_words = folded(prompt)
    left, copies, before = without_prompt(words, prompt_words)
    if cut_off or holder:
        out["truncated"] = [-1, -1, -1, -1, -1]
    else:
        stops = tail_key(response)
        # a short answer that recurs as a whole is whole, whatever its end looks like inside sentences
        short = len(words) <= 8 and not ends and not fences
        whole = short and form_share >= 0.002 and not _DANGLING.search(response)
        if stops is None or fences % 2:
            tail_vote = 0
        elif whole or (copies and not left):
            tail_vote = -1
        elif tail_seen < 3:
            tail_vote = 1
        else:
            tail_vote = 1 if tail <= 0.15 else -1 if tail >= 0.5 else 0
        out["truncated"] = [_sign(fences % 2 == 1), _sign(bool(_DANGLING.search(response)) and not fences % 2), _sign(not ends or fences % 2 == 1), tail_vote, _sign(not whole) if short else 0]

    rest = " ".join(left) if copies else response
    told = re.sub(r"[’`]", "'", response.lower())
    if holder or (copies and not left):
        out["refusal"] = [-1, -1, -1, -1, -1]
    else:
        out["refusal"] = [_sign(bool(cue.search(told))) for cue in (_INABILITY, _APOLOGY, _META, _REDIRECT)]
        out["refusal"].append(-1 if re.search(r"\d", rest) else 1 if len(left) >= 3 else 0)

    if not prompt_words or holder:
        out["copy"] = [-1, -1, -1]
    else:
        tail_part = left[before:]
        partial = cut_off and copies > 0 and tail_part == prompt_words[: len(tail_part)]
        broken = cut_off and copies > 0 and len(tail_part) > 0 and tail_part[:-1] == prompt_words[: len(tail_part) - 1]
        only = copies > 0 and before <= 4 and (not tail_part or partial or broken)
        have, want = Counter(words), Counter(prompt_words)
        inside = sum(min(n, want[w] * max(1, copies)) for w, n in have.items()) / max(1, len(words))
        full = sum((have & want).values()) / len(prompt_words)
        squeezed, seed = "".join(words), "".join(prompt_words)
        remainder = squeezed.replace(seed, "") if len(seed) >= 8 else squeezed
        near = seed in squeezed and (len(remainder) <= 20 and not re.search(r"\d", remainder) or cut_off and seed.startswith(remainder))
        out["copy"] = [_sign(only), 1 if inside >= 0.8 and full >= 0.95 and len(words) < 1.4 * max(1, copies) * len(prompt_words) else -1 if inside < 0.7 or full < 0.8 else 0, _sign(near)]

    allowed = requested(prompt)
    spoken = Counter(x for x in language(prompt, model) if x)
    own = spoken.most_common(1)[0][0] if spoken else None
    if own is None or holder or (copies and len(left) < 5):
        out["other_language"] = [-1 if holder or copies else 0] * 3
    else:
        text = " ".join(left) if copies else response
        got = language(text, model)
        out["other_language"] = [_sign(None if g is None else g != own and g not in allowed) for g in got]
    return out


STATISTICS = "keys array<long>, ends array<long>, mids array<long>, grams array<int>, n_grams array<long>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row the shape of the whole response and the keys of its tail; the first row of a
    batch carries the batch's counts of endings and of letter trigrams per language."""
    for b in batches:
        ends: Counter = Counter()
        mids: Counter = Counter()
        grams = np.zeros(len(LANGS) * BUCKETS, np.int64)
        forms, tails = [], []
        for prompt, response in zip(b["prompt"], b["response"], strict=True):
            text = plain(response)
            count_endings(plain(prompt), ends, mids)
            count_endings(text, ends, mids)
            prose = _prose(text)
            lang = by_words(_WORD.findall(prose.lower()))
            if lang:
                np.add.at(grams, trigrams(prose) + LANGS.index(lang) * BUCKETS, 1)
            forms.append(_key(shape(text)))
            tokens = tail_key(text)
            padded = ["^"] + tokens if tokens else []
            tails.append([_key(padded[-n:]) for n in TAILS if len(padded) >= n])
        keys = list(ends.keys() | mids.keys())
        seen = np.flatnonzero(grams)
        first = (keys, [ends[k] for k in keys], [mids[k] for k in keys], seen.astype(np.int32), grams[seen])
        rest = [((), (), (), (), ())] * (len(b) - 1)
        counts = pd.DataFrame([first, *rest][: len(b)], columns=["keys", "ends", "mids", "grams", "n_grams"])
        yield pd.concat([pd.DataFrame({"id": b["id"], "prompt": b["prompt"], "response": b["response"], "form": forms, "tails": tails}).reset_index(drop=True), counts], axis=1)


def label(pairs: DataFrame) -> DataFrame:
    """(id, defect, posterior) for every pair and defect, from pairs (id, prompt, response)."""
    spark = pairs.sparkSession
    base = pairs.filter("id is not null").groupBy("id").agg(F.min(F.struct(F.col("response").isNull().alias("z"), "response", "prompt")).alias("r"))
    rows = cut(base.select("id", "r.prompt", "r.response").mapInPandas(_read, "id string, prompt string, response string, form long, tails array<long>, " + STATISTICS))
    # statistics over all rows
    endings = rows.select(F.explode(F.arrays_zip("keys", "ends", "mids")).alias("c")).groupBy(F.col("c.keys").alias("key"))
    endings = endings.agg(F.sum("c.ends").alias("ends"), F.sum("c.mids").alias("mids")).filter("ends + mids >= 3")
    counts = rows.select(F.explode(F.arrays_zip("grams", "n_grams")).alias("c")).groupBy("c.grams").agg(F.sum("c.n_grams").alias("n")).collect()  # at most len(LANGS) * BUCKETS rows
    seen = np.zeros((len(LANGS), BUCKETS))
    for r in counts:
        seen[r["grams"] // BUCKETS, r["grams"] % BUCKETS] = r["n"]
    model = spark.sparkContext.broadcast(Trigrams({lang: c for lang, c in zip(LANGS, seen, strict=True) if c.any()}))

    # a repeated pair vouches for nothing, so shapes are counted by distinct prompts
    asked = rows.select("form", F.xxhash64("prompt").alias("p")).distinct()
    total = max(rows.select(F.xxhash64("prompt")).distinct().count(), 1)
    forms = asked.groupBy("form").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / total).alias("form_share"))
    forms = small(forms.filter("n >= 3 and form_share >= 0.002").drop("n"))  # at most 500
    # the longest tail that occurs often enough decides; equal tails are looked up once
    known = rows.select(F.col("tails").alias("at")).filter(F.size("at") > 0).distinct().select("at", F.posexplode("at").alias("place", "key"))
    known = known.join(endings, "key").groupBy("at").agg(F.min_by(F.struct("ends", "mids"), "place").alias("t"))
    stats = rows.select("id", "prompt", "response", "form", F.col("tails").alias("at")).join(forms, "form", "left").join(known, "at", "left")
    stats = stats.select("id", "prompt", "response", F.coalesce("form_share", F.lit(0.0)).alias("form_share"), F.col("t.ends").alias("ends"), F.col("t.mids").alias("mids"))

    def cast_votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for prompt, response, share, ends, mids in zip(b["prompt"], b["response"], b["form_share"], b["ends"], b["mids"], strict=True):
                seen = 0 if ends != ends or ends is None else int(ends + mids)
                got.append(votes(prompt, response, ends / seen if seen else None, seen, share, model.value))
            yield pd.DataFrame({"id": b["id"], **{d: [v[d] for v in got] for d in DEFECTS}})

    # voting is the costly step: an exchange with a number is not coalesced to few parts
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ballots = stats.repartition(parts, "id").mapInPandas(cast_votes, "id string, " + ", ".join(f"{d} array<int>" for d in DEFECTS))
    ballots = cut(ballots)
    flat = ballots.select("id", F.explode(F.create_map(*[x for d in DEFECTS for x in (F.lit(d), F.col(d))])).alias("defect", "votes"))
    patterns = flat.groupBy("defect", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** 5 per defect
    weights = []
    for d in DEFECTS:
        own = [p for p in patterns if p["defect"] == d]
        if own:
            prior = np.array(list(FUNCTIONS[d].values()))
            post = labelmodel.fit(np.array([p["votes"] for p in own]), np.array([p["n"] for p in own], float), prior, SHARES[d])
            weights += [(d, p["votes"], float(q)) for p, q in zip(own, post, strict=True)]
    table = spark.createDataFrame(weights, "defect string, votes array<int>, posterior double")
    return flat.join(F.broadcast(table), ["defect", "votes"]).select("id", "defect", "posterior")


def of_benchmark(benchmark: DataFrame) -> DataFrame:
    return label(benchmark.select("id", "prompt", F.col("response_preview").alias("response")))


def found(benchmark: DataFrame) -> DataFrame:
    """(id, defect)."""
    cutoff = F.create_map(*[x for d, c in CUTOFFS.items() for x in (F.lit(d), F.lit(c))])
    return of_benchmark(benchmark).filter(F.col("posterior") >= cutoff[F.col("defect")]).select("id", "defect")
