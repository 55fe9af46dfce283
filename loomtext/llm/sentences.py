"""Problem 3: sentence boundaries across languages and scripts.

Segmentation rules come in tables as in SRX: a rule says whether there is a break
where one pattern ends and another begins. Tables cascade: that of a paragraph's
language, that of its script, and the common one; the first rule that matches a
position decides it, and a position that no rule matches is none. Positions lie
between tokens. Patterns see tokens in their clean spelling, one per line, with
quotation marks turned into ⟪ and ⟫ by the way the paragraph uses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomtext.functions.arrow import tokens_of
from loomtext.llm.lookalike import clean_form

NO, BREAK = False, True
#: Stands for small letters, which tell nothing in a paragraph without capitals.
_SMALL = r"\p{Ll}\p{Mn}"


def _words(text: str) -> str:
    return "(?i:" + "|".join(map(regex.escape, text.split())) + ")"


def _never(words: str) -> tuple[str, str, bool]:
    """An abbreviation within a sentence."""
    return rf"^{_words(words)}\n\.", "", NO


def _maybe(words: str) -> tuple[str, str, bool]:
    """An abbreviation that may stand at the end too: within, a small letter, a number
    or a mark goes on."""
    return rf"^{_words(words)}\n\.", rf"[{_SMALL}\p{{N}},;:)\]]", NO


def _letters(*pairs: str) -> list[tuple[str, str, bool]]:
    """Two-letter abbreviations with a full stop after each part."""
    out = []
    for a, b in map(str.split, pairs):
        out += [(rf"^(?i:{a})\n\.", rf"(?i:{b})\n\.", NO), (rf"^(?i:{a})\n\.\n^(?i:{b})\n\.", r"(?=\P{Lu})", NO)]
    return out


def _number(words: str) -> tuple[str, str, bool]:
    """An abbreviation before a number."""
    return rf"^{_words(words)}\n\.", r"\p{N}", NO


def _speaker(words: str) -> tuple[str, str, bool]:
    """Who spoke, after the speech."""
    return "⟫", rf"{words}", NO


_INITIAL = (r"^\p{Lu}\n\.", r"[\p{Lu}]", NO)
_LATIN_JOIN = "and but or so because since while although though unless where which when et mais ou donc car quoique lorsque parce tandis puisque und aber oder denn weil sodass obwohl damit während"

#: (what stands before, what comes after, whether it is a break), in order.
RULES: dict[str, list[tuple[str, str, bool]]] = {
    "en": [
        (r"^(?i:p|a)\n\.", r"(?i:m)\n\.", NO),
        (r"^(?i:[pa])\n\.\n^(?i:m)\n\.", "[^⟫)]", BREAK),
        (r"^(?i:e)\n\.", r"(?i:g)\n\.", NO), (r"^(?i:i)\n\.", r"(?i:e)\n\.", NO),
        (r"^(?i:e)\n\.\n^(?i:g)\n\.", "", NO), (r"^(?i:i)\n\.\n^(?i:e)\n\.", "", NO),
        (r"^(?i:ph)\n\.\n^(?i:d)\n\.", r"\p{Lu}", BREAK), *_letters("ph d", "b a", "m a", "b sc", "m sc", "a m", "n b", "v s"),
        _never("dr prof capt gen st mr mrs ms sr jr col lt rev hon dept vs gov sen rep sgt maj cmdr brig adm supt messrs mme mlle pres"),
        _number("no nos fig figs vol vols approx p pp ch chap sec secs eq eqs ed eds par art jan feb aug sept oct nov dec tel ext"),
        _maybe("inc ltd co corp bros llc plc assn ave blvd rd est al cf ca viz esp incl max min misc univ"),
        _speaker(r"(?i:said|asked|wrote|replied|answered|cried|shouted|added|whispered|told)\b"),
    ],
    "de": [
        (r"^(?i:z)\n\.", r"(?i:b)\n\.", NO), (r"^(?i:d)\n\.", r"(?i:h)\n\.", NO), (r"^(?i:u)\n\.", r"(?i:a)\n\.", NO),
        (r"^(?i:z)\n\.\n^(?i:b)\n\.", "", NO), (r"^(?i:d)\n\.\n^(?i:h)\n\.", "", NO),
        (r"^\p{Nd}{1,2}\n\.", r"(?i:januar|jänner|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jahrhundert)\b", NO),
        *_letters("o ä", "u ä", "i d", "z t", "s o", "v a"),
        _never("dr prof hr fr st bzw bspw vgl inkl dipl ing frl hrsg exkl ggf sog evtl zzgl geb gest"), _number("nr abs ca art kap bd s bde abb tab jg jan feb aug sept okt nov dez tel"),
        _maybe("usw usf co mio mrd jh str"),
        _speaker(r"(?i:sagte|fragte|rief|schrieb|antwortete|meinte)\b"),
    ],
    "fr": [
        (r"^(?i:p)\n\.", r"(?i:ex)\n\.", NO), (r"^(?i:p)\n\.\n^(?i:ex)\n\.", "", NO),
        *_letters("c à", "n b"),
        _never("dr pr m mm mme mlle st ste cf mgr me mmes mlles"), _number("fig env art no p pp vol chap tél janv févr sept oct nov déc"),
        _maybe("av bd éd hab"),
        _speaker(r"(?i:dit|demanda|répondit|écrivit|cria|ajouta)\b"),
    ],
    "gu": [
        (r"^કિ\n\.", r"મી\n\.", NO), (r"^કિ\n\.\n^(?:મી|ગ્રા)\n\.", "", NO),
        _never("ડૉ ડો શ્રી શ્રીમતી કુ કુમારી પ્રો સૌ સ્વ"), _number("તા નં રૂ પૃ"), _speaker(r"એમ\b"),
    ],
    "hi": [
        (r"^कि\n\.", r"मी\n\.", NO), (r"^कि\n\.\n^(?:मी|ग्रा)\n\.", "", NO),
        _never("डॉ श्री श्रीमती पं प्रो स्व कु"), _number("रु सं क्र पृ"), _speaker(r"ऐसा\b"),
    ],
    "es": [
        *_letters("p ej", "s a", "ee uu", "a c", "d c"),
        _never("sr sra srta srs sres dr dra dres prof profa lic ing gral d dña ud uds vd vds st sto sta"), _number("núm n pág págs art fig vol cap tel aprox"), _maybe("cía av avda ed"),
        _speaker(r"(?i:dijo|preguntó|respondió|gritó|contestó|añadió)\b"),
    ],
    "it": [
        *_letters("p es", "s p", "a c", "d c", "n b"),
        _never("sig sigg sigra dott dr prof ing avv arch geom rag on mons"), _number("n num pag pagg art fig vol cap tel ca"), _maybe("ecc"),
        _speaker(r"(?i:disse|chiese|rispose|gridò|aggiunse)\b"),
    ],
    "pt": [
        *_letters("p ex", "s a", "a c", "d c"),
        _never("sr sra srta srs dr dra prof profa eng exmo exma st sto sta dom"), _number("n núm pág págs art fig vol cap tel aprox"), _maybe("cia av ed ltda"),
        _speaker(r"(?i:disse|perguntou|respondeu|gritou|acrescentou)\b"),
    ],
    "nl": [*_letters("d w", "o a", "m b", "b v", "n v"), _never("dr prof dhr mevr mw drs ing ir mr st bijv"), _number("nr blz art afb hfdst ca"), _maybe("enz"), _speaker(r"(?i:zei|vroeg|antwoordde|riep)\b")],
    "pl": [*_letters("m in", "n p", "b r"), _never("dr prof inż mgr hab ks św gen płk kpt ul al tzn tj np"), _number("nr str art rys ust pkt ok tel"), _maybe("itd itp"), _speaker(r"(?i:powiedział|powiedziała|zapytał|zapytała)\b")],
    "ru": [
        *_letters("т е", "т к", "и о", "н э", "т н", "т д", "т п"), (r"^и\nт\n\.", r"[дп]\n\.", NO),
        _never("г-н г-жа проф акад доц им св ген полк тов гр ул обл пер пл наб просп напр"), _number("стр рис гл п пп ст табл см ок тел № кн вып"), _maybe("г гг в вв руб коп тыс млн млрд др пр"),
        (r"^\p{Lu}\n\.", r"\p{Lu}", NO), _speaker(r"(?i:сказал|сказала|спросил|спросила|ответил|ответила|крикнул|крикнула)\b"),
    ],
    "ur": [_speaker(r"یوں\b")],
    "am": [_speaker(r"ብሎ\b")],
    "zh": [_speaker(r"[他她我](?:們)?[說说問问]")],
    "ja": [_speaker(r"と.*(?:言った|話した|聞いた)")],
    "th": [(r"(?:ครับ|ค่ะ|คะ|จ้ะ|จ๊ะ)", r"(?![.!?⟫)])", BREAK)],
    "Latin": [_maybe("etc"), (r"\.{2,}", rf"(?:{'|'.join([*_LATIN_JOIN.split(), *_LATIN_JOIN.upper().split()])})\b", NO), _INITIAL, (r"^\p{Latin}\n\.", r"\p{Latin}\n\.", NO), (r"^\p{Latin}\n\.\n^\p{Latin}\n\.", r"\p{Ll}", NO)],
    "Indic": [(r"(?:^|\n)[।॥|]+", r"[^⟫)\]]", BREAK)],
    "common": [
        (r"(?:^|\n)\p{Nd}+\n\.", r"\p{Nd}+(?:%|\n|\Z)", NO),
        (r"", r"[⟫)\]}’”»」』]", NO),
        (r"⟫", r"\p{Ll}", NO),
        (r"(?:^|\n)[.!?…。！？।॥۔؟።፧]+(?:\n[⟫)\]}])*", "", BREAK),
        (r"(?:^|\n)፡፡(?:\n[⟫)\]}])*", "", BREAK),
        (r"(?:^|\n)[।॥|]+(?:\n[⟫)\]}])*", "", BREAK),
    ],
}
_CASCADE = {
    **{k: (k, "Latin") for k in ("en", "de", "fr", "es", "it", "pt", "nl", "pl")}, "la": ("en", "de", "fr", "Latin"),
    "gu": ("gu", "Indic"), "hi": ("hi", "Indic"), **{k: (k,) for k in ("ur", "am", "zh", "ja", "th", "ru")}, "xx": ("en", "de", "fr", "gu", "hi", "Latin"),
}
#: Of languages with equally many, the first counts.
_FUNCTION_WORDS = {
    "en": "the a an and this that his her one is of in on with from",
    "de": "der die das und ein eine dieser diese ist von mit auf",
    "fr": "le la les un une et ce cette est de dans avec",
    "es": "el los las y es por con que una del al para su como pero",
    "it": "il lo gli e è di che per con non una della nel sono ma",
    "pt": "o os as e é do da dos que uma para com não em mas",
    "nl": "het een en van is dat niet op te zijn voor met maar",
    "pl": "i w z na się nie jest to że do jak ale od przez",
}
_SCRIPTS = {"la": r"\p{Latin}", "gu": r"\p{Gujarati}", "hi": r"\p{Devanagari}", "ur": r"\p{Arabic}", "am": r"\p{Ethiopic}", "th": r"\p{Thai}", "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "ru": r"\p{Cyrillic}"}
_MARK = regex.compile(r"(?:[.!?…。！？।॥|۔؟።፧፡]+|[\"“”»」』⟫)\]}’]|.*(?:ครับ|ค่ะ|คะ|จ้ะ|จ๊ะ))\Z", regex.DOTALL)
#: Tokens that a rule can see before and after a position.
BEFORE, AFTER = 6, 3


class Cascade:
    """The tables of a language, as one pattern whose alternatives are its rules."""

    def __init__(self, lang: str, cased: bool = True) -> None:
        rules = [r for t in (*_CASCADE[lang], "common") for r in RULES[t]]
        self.breaks = [b for *_, b in rules]
        parts = []
        for before, after, _ in rules:
            before = before.replace(r"\n^", r"\n").removeprefix("^")
            edge = r"(?<![^\n])" if not before.startswith("(?:^|\\n)") and before not in ("", "⟫") and not before.startswith(r"(?:ครับ") and not before.startswith(r"\.{2") else ""
            after = after if cased else after.replace(_SMALL, "")
            parts.append(rf"((?<={edge}{before})(?=\n{after}))")
        self.pattern = regex.compile("|".join(parts))

    def decide(self, before: str, after: str) -> bool:
        m = self.pattern.match(f"{before}\n{after}", len(before))
        return bool(m) and self.breaks[m.lastindex - 1]


def _quotes(tokens: list[str], arabic: bool) -> list[str]:
    """Quotation marks by their use here: “ closes after „, ” opens in right-to-left
    text, and a straight mark opens and closes by turns."""
    german, opened, out = "„" in tokens, False, []
    for t in tokens:
        if t == '"':
            opened = not opened
            t = "⟪" if opened else "⟫"
        elif t in "„«「『":
            t = "⟪"
        elif t in "»」』":
            t = "⟫"
        elif t == "“":
            t = "⟫" if german or arabic else "⟪"
        elif t == "”":
            t = "⟪" if arabic else "⟫"
        out.append(t)
    return out


_QUOTE = frozenset('"„«「『»」』“”')


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cascades = {(k, cased): Cascade(k, cased) for k in _CASCADE for cased in (True, False)}
    kinds = {k: regex.compile(p) for k, p in _SCRIPTS.items()}
    functions = {k: frozenset(ws.split()) for k, ws in _FUNCTION_WORDS.items()}
    scripts, langs = list(_SCRIPTS), list(_FUNCTION_WORDS)
    for batch in batches:
        words, row = tokens_of(batch.column(1))
        if not len(words):
            continue
        coded = words.cast(pa.string()).dictionary_encode()
        vocabulary = [clean_form(w) for w in coded.dictionary.to_pylist()]
        codes = np.asarray(coded.indices)
        mark = np.fromiter((bool(_MARK.match(w)) for w in vocabulary), bool, len(vocabulary))
        quote = np.fromiter((w in _QUOTE for w in vocabulary), bool, len(vocabulary))
        script = np.fromiter((next((i for i, k in enumerate(scripts) if kinds[k].search(w)), -1) if w else -1 for w in vocabulary), np.int64, len(vocabulary))
        small = [w.lower() for w in vocabulary]
        lang = [np.fromiter((w in ws for w in small), bool, len(small)) for ws in functions.values()]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        ends = np.r_[starts[1:], len(row)]
        by_script = np.stack([np.add.reduceat((script == i)[codes].astype(np.int64), starts) for i in range(len(scripts))])
        by_lang = np.stack([np.add.reduceat(own[codes].astype(np.int64), starts) for own in lang])
        capital = np.fromiter((w != v for w, v in zip(vocabulary, small, strict=True)), bool, len(vocabulary))
        cased = np.logical_or.reduceat(capital[codes], starts)
        has_quote = np.logical_or.reduceat(quote[codes], starts)
        main, total = by_script.argmax(0), by_script.sum(0)
        main[(by_script[scripts.index("ja")] > 0) & np.isin(main, [scripts.index("zh"), scripts.index("ja")])] = scripts.index("ja")
        which, said = by_lang.argmax(0), by_lang.max(0)
        at_mark = np.flatnonzero(mark[codes])
        lo, hi = np.searchsorted(at_mark, starts), np.searchsorted(at_mark, ends)
        out_row, out_end = [], []
        for r in range(len(starts)):
            a, b = int(starts[r]), int(ends[r])
            ks = at_mark[lo[r] : hi[r]]
            if len(ks):
                name = scripts[main[r]] if total[r] else "xx"
                if name == "la" and said[r]:
                    name = langs[which[r]]
                decide = cascades[name, bool(cased[r])].decide
                tokens = [vocabulary[c] for c in codes[a:b]]
                if has_quote[r]:
                    tokens = _quotes(tokens, name == "ur")
                for k in ks:
                    i = int(k) - a + 1
                    if i < b - a and decide("\n".join(tokens[max(0, i - BEFORE) : i]), "\n".join(tokens[i : i + AFTER])):
                        out_row.append(row[a])
                        out_end.append(i)
            out_row.append(row[a])
            out_end.append(b - a)
        yield pa.record_batch({"id": batch.column(0).take(pa.array(np.array(out_row))), "end_token": pa.array(out_end, pa.int32())})


def sentence_ends(df: DataFrame, key: str, sentences: str = "sentences") -> DataFrame:
    """One row per sentence of each row of `df`: `key` and `end_token`, the number
    of tokens up to and including the sentence's last one.

    The tokens are the row's inner lists joined in order, without null lists and
    tokens. A row with tokens has at least one sentence and its last one ends with
    the last token; null and empty rows give none; repeated rows are cut each for
    itself; other columns are not read. There is no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, sentences).mapInArrow(_ends, f"id {kind}, end_token int").withColumnRenamed("id", key)
