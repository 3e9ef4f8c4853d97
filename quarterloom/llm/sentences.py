"""Sentence boundaries across languages and scripts, in SQL expressions.

Every step replaces single characters by single private-use placeholders, so that positions never
move: stops that end nothing (decimals, addresses, file names, abbreviations, initials, ordinals, stops
within quotations and brackets) are masked, paragraph breaks and list items become breaks, and the last character of every
sentence becomes an end mark, found by the terminators of its script. The masked text is then cut at
the marks; a sentence is the original text between its positions, which restores what was masked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MASK, OPEN, CLOSE, CORNER, BREAK, END, INNER, FULL, HELD, SAID = "\ue000", "\ue001", "\ue002", "\ue006", "\ue003", "\ue004", "\ue005", "\ue007", "\ue008", "\ue009"

#: Characters that one step maps to one of their kind: white space, stops, brackets, quotation marks.
SPACES = "\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
KINDS = {SPACES: " ", "。！？।॥": FULL, "؟": "?", "）】": ")", "（": "(", "”»": CLOSE, "„«「『": OPEN, "」』": CORNER}
WIDE = "．"  # FULL, too, but for decimals
BLANKS = " \n\r" + BREAK
WS_CHARS = r" \n\r" + BREAK
WS = f"[{WS_CHARS}]"
NL = r"(?:\n|\r(?!\n))"
BULLET = r"[•‣◦▪●∙*-]"
NUMBER = r"(?:\d{1,3}[.)]|\(\d{1,3}\))"
STOPS = ".!?…" + FULL  # FULL stands for the stops of scripts that write no space behind them
#: Latin letters, the accented ones composed; told by ranges, as a look-up of the script costs several times as much.
LATIN = "A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ"
#: A small letter that begins no sentence; one before a capital may, as in iPhone and eBay.
SMALL = r"\p{Ll}(?!\p{Lu})"

# Abbreviations that end no sentence, by language.
NEVER = {
    "en": "Mr Mrs Ms Messrs Dr Prof Rev Hon Gen Gov Sen Rep Lt Col Maj Capt Cmdr Adm Sgt Cpl Pvt Supt Insp Amb Atty St Mt cf vs e.g i.e viz incl excl approx est adj acct avg max min No no Nos nos Sec sec Secs para paras Para Fig fig Figs figs Tab Vol vol Ch ch pp p.p Eq eq Art art Ex Rs dept Dept "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "Nr Nrn Abb Abs Art Bd Fa Hr Hrn Fr Frl bzw ca evtl ggf inkl exkl rd sog vgl Vgl Tab Ziff zzgl Dipl Ing Dr Prof Str Kap Anm Anh Mio Mrd Tsd z.B d.h u.a i.d.R bspw",
    "fr": "Mme Mlle MM Mgr art Art al chap cf env fig Fig p.ex pp vol av bd ét min max c.-à-d",
    "es": "Sr Sra Srta Sres Sras Dr Dra Dres Prof Ud Uds Vd art Art arts cap núm num pág págs pag párr ap aprox fig Fig tab vol p.ej EE Lic Ing Gral",
    "ru": "стр гл рис табл см ср напр тыс руб коп ул им проф акад др т.е т.к гр обл оз стат п.п ок прибл Табл Рис Стр См",
    "hi": "डॉ प्रो श्री सु कु पं रु",
}
# Abbreviations that end a sentence only if the next word can begin one.
SOMETIMES = "Inc Corp Co Ltd Bros plc Jr Sr.Jr etc a.m p.m usw ff uvm usf etw UU др пр г гг в вв млн млрд тыс S.A Cía Cia Hnos".split()
# Names that end in a mark; prepositions before a name; words that begin a sentence and no name's second word.
NAMES = "Yahoo Yum Jeopardy Joomla Kahoot".split()
BEFORE = "of in by from with at for on de von bei von aus di da do".split()
STARTERS = (
    "The A An It We You They He She I This That These Those There Here Its Our Their His Her My Each Every Both Either Neither Few Several Such Much More Most Other Another One Two Three Some Any Many All None "
    "Nobody Nothing Everybody Everyone Everything Somebody Someone Something Anyone In On At By For From Of To With About Above Across After Against Along Among Around As Before Behind Below Between Beyond Despite "
    "During Except Inside Into Like Near Off Outside Over Per Since Through Under Unlike Until Upon Via Within Without If When While Where Whether Although Though Because Unless Once But And Or So Yet Nor No Not "
    "What Why How Who Which Do Does Did Don Is Are Was Were Has Have Had Can Could Will Would Should May Might Let See Please Then Thus However Still Also Now Today Yesterday Perhaps Maybe Meanwhile Moreover Instead Only Even "
    "Der Die Das Ein Eine Es Wir Sie Er Im Am Le La Les Un Une Il Elle Nous Vous Ce El Los Las Una"
).split()
# What attributes a quotation in corner brackets; words that go on after an ellipsis.
QUOTED = "と って という 、 ，".split()
ONWARD = "但 而 却 可是 不过 然而 只是 だが しかし".split()
# Words behind a German ordinal.
ORDINAL = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Quartal Quartals Halbjahr Halbjahres Jahrhundert Geschäftsjahr Auflage Kapitel Absatz".split()

# What file names and addresses without a scheme end in, in small letters or capitals; those of
# file names that are no words also with a capital.
FILES = "pdf docx xls xlsx xlsm ppt pptx odt ods csv tsv txt rtf xml xsd xbrl htm html json yaml yml cfg sql ipynb js css php gz parquet db dat png jpg jpeg gif svg mp3 mp4".split()
SUFFIXES = FILES + "doc md log ini py zip tar com org net gov edu mil info biz eu uk de fr es ru cn jp kr".split()


def _word(w: str) -> str:
    """A pattern for a word, its accents composed or not."""
    import re
    import unicodedata

    out = []
    for ch in w:
        d = unicodedata.normalize("NFD", ch)
        c = re.escape(ch) if not ch.isalnum() else ch
        out.append(c if d == ch else f"(?:{c}|{d})")
    return "".join(out)


def _any(words: Sequence[str]) -> str:
    """One of the words, the longest first; grouped by their first letter, so that few are tried."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by.setdefault(_word(w[0]), []).append(_word(w[1:]))
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


Step = Callable[[Column], Column]


def _mask(pattern: str, by: str = MASK) -> Step:
    return lambda s: F.regexp_replace(s, F.lit(pattern), F.lit(by))


def _mask_within(opener: str, valid: str, delimiters: str, by: str = MASK) -> Step:
    """Masks the stops between an opening mark that is ``valid`` and the next of the ``delimiters``.

    A match begins at an opener or where the last one ended, so the text is gone through once.
    """
    run = f"[^{STOPS}{delimiters}{BREAK}]*+"
    return _mask(f"({opener}{valid}{run}|\\G(?!^){run})[{STOPS}]", f"$1{by}")


def _all(*steps: Step) -> Step:
    def run(s: Column) -> Column:
        for f in steps:
            s = f(s)
        return s

    return run


def _swap(old: str, new: str) -> Step:
    return lambda s: F.replace(s, F.lit(old), F.lit(new))


def _has(*parts: str) -> Step:
    """Whether any of the parts occurs: what a step looks for, so that other texts pass it by."""
    return lambda s: reduce(lambda a, b: a | b, [F.contains(s, F.lit(p)) for p in parts])


def _like(pattern: str) -> Step:
    return lambda s: F.rlike(s, F.lit(pattern))


def _not_ascii(s: Column) -> Column:
    return F.octet_length(s) > F.length(s)


def _steps() -> list[tuple[Step | None, Step]]:
    """The steps in order, each with the condition under which a text needs it at all.

    In all patterns the rare character comes first and what must precede it is looked up behind it.
    """
    marks = MASK + OPEN + CLOSE + CORNER + BREAK + END + INNER + FULL + HELD + SAID
    old, new = marks + "".join(KINDS), "\ufffd" * len(marks) + "".join(v * len(k) for k, v in KINDS.items())
    kinds_of_characters: Step = lambda s: F.translate(s, old, new)
    steps: list[tuple[Step | None, Step]] = [(lambda s: _not_ascii(s) | F.rlike(s, F.lit("[\t\x0b\x0c\x1c-\x1f]")), kinds_of_characters)]
    # decimals, then addresses and file names: stops from their first word to the last that a character of them follows
    steps.append((None, _all(_mask(f"[.{WIDE}](?=\\p{{Nd}})(?<=\\p{{Nd}}.)"), _swap(WIDE, FULL))))
    part = f"[{LATIN}\\p{{M}}\\p{{Nd}}_%+{MASK}-]"
    suffix = f"(?:{_any([*SUFFIXES, *map(str.upper, SUFFIXES), *map(str.capitalize, FILES)])})"
    is_one = f"(?=://[^{WS_CHARS}]|(?:\\.{part}++)*+@{part}|(?:\\.{part}++)++(?<=\\.{suffix}))|(?<=[Ww]{{3}})(?=\\.)"
    run = f"[{LATIN}\\p{{M}}\\p{{Nd}}_~:/#@$&'*=%+{MASK}-]*+"
    address = _mask(f"((?<!{part}|[.@]){part}++(?:{is_one}){run}|\\G(?!^){run})[.!?](?=[{LATIN}\\p{{Nd}}_~/#&=%+-])", f"$1{MASK}")
    maybe = lambda s: _has("://", "@", "ww.", "WW.")(s) | _like(f"\\.{suffix}(?!{part})")(s)
    steps.append((maybe, address))
    # a blank line ends a unit; list items begin one: bulleted ones on any line, numbered ones in a paragraph that begins so
    steps.append((_has("\n", "\r"), _mask(f"{NL}(?= *(?:[\\r\\n]|{BULLET} ))", BREAK)))
    line = f"[^\n\r{BREAK}]*+(?:\r(?=\n))?+"
    begun = f"[ \n\r]*+{NUMBER} "
    steps.append((lambda s: _like(f"^{begun}")(s) | _like(f"{BREAK}{begun}")(s), _all(
        _mask(f"((?:^|{BREAK}){begun}{line}|\\G(?!^){line})[\n\r]", f"$1{HELD}"), _mask(f"{HELD}(?= *{NUMBER} )", BREAK), _swap(HELD, "\n"),
        _mask(f"((?:^|{BREAK})[ \n\r]*+\\d{{1,3}})\\.(?= )", f"$1{MASK}"),
    )))
    # quotation marks become opening and closing ones; those that are not closed in their paragraph are ordinary
    shut = CLOSE + CORNER
    opening = f'"(?=[^{WS_CHARS}])(?<![^{WS_CHARS}(\\[{{{OPEN}“‘—-]")|“(?![{WS_CHARS},.;:!?)\\]{CLOSE}…]|$)'
    steps.append((_has('"', "“"), _all(_mask(opening, OPEN), _swap('"', CLOSE), _swap("“", CLOSE))))
    # stops within quotations: the last before the closing mark may end the whole, the others nothing
    steps.append((_has(OPEN), _all(_mask(f"{OPEN}(?![^{OPEN}{shut}{BREAK}]*+[{shut}])"), _mask_within(OPEN, "", OPEN + shut, HELD))))
    steps.append((_has(HELD), _all(_mask(f"{HELD}(?=[{HELD}{WS_CHARS}]*+[{shut}])", INNER), _swap(HELD, MASK))))
    steps.append((_has("‘"), _mask_within("‘", f"(?=[^‘’{BREAK}]*+’(?!\\p{{L}}))", "‘’")))
    # stops within brackets: the last ends the whole if the bracket stands by itself
    closed = f"(?=[^(){BREAK}]*+\\))"
    steps.append((_has("("), _mask_within(f"\\((?<=(?:^|[{STOPS}{shut}{BREAK}:]){WS}{{0,99}}\\()", closed, "()", HELD)))
    steps.append((_has(HELD), _all(_mask(f"{HELD}(?={HELD}*+\\))", INNER), _swap(HELD, MASK))))
    steps.append((_has("("), _mask_within("\\(", closed, "()")))
    steps.append((_has("["), _mask_within("\\[", f"(?=[^\\[\\]{BREAK}]*+\\])", "\\[\\]")))
    # the closing marks of quotations that words before a colon introduce
    steps.append((lambda s: _has(OPEN)(s) & _has(INNER)(s), _mask(f"([：，:]{OPEN}[^{OPEN}{shut}]*+(?<={INNER})){CLOSE}", f"$1{SAID}")))
    shut += SAID
    # abbreviations, initials (but for the last of a Russian pair that may end a sentence), ordinals
    start, word = r"(?<![\p{L}\p{M}\p{N}.])", r"(?<![\p{L}\p{M}\p{N}])"
    never = _any([w for ws in NEVER.values() for w in ws.split() if w not in SOMETIMES])
    able = f"{WS}+(?:<[^<>]*+>{WS}*)?(?![,;:&/%)])[^\\p{{L}}\\p{{N}}]*+(?:\\p{{Lu}}|\\p{{Ll}}\\p{{Lu}})"
    sometimes = _any(SOMETIMES) + r"|\p{Lu}\.\p{Lu}|\p{Lu}\.\p{Lu}\.\p{Lu}"
    kinds = [
        f"(?<={start}[\\p{{L}}&&[^гдп]]\\.|\\p{{L}}{WS}г\\.)", f"(?<={word}(?:{never})\\.)", f"(?<=\\d\\.)(?={WS}+(?:{_any(ORDINAL)})(?!\\p{{L}}))",
        f"(?:(?<={start}[гдп]\\.)|(?<={word}(?:{sometimes})\\.))(?!{able})",
    ]
    steps.append((_has("."), _mask(f"\\.(?={WS})(?:{'|'.join(kinds)})")))
    # names with a mark: well-known ones, and a capital word behind a preposition, before another that begins no sentence
    after = f"(?={WS}\\p{{Lu}}\\p{{Ll}}++(?![\\p{{L}}/])(?!{WS}(?:{_any(BEFORE)}|per|to){WS}))(?!{WS}(?:{_any(STARTERS)})(?!\\p{{L}}))"
    steps.append((_has("!"), _mask(f"!{after}(?:(?<={word}(?:{_any(NAMES)})!)|(?<={word}(?:{_any(BEFORE)}){WS}\\p{{Lu}}\\p{{Ll}}{{1,60}}!))|!(?={WS}\\p{{Ll}})(?<={word}(?:{_any(NAMES)})!)")))
    # end marks: the last of stops and closing marks, if what follows can begin a sentence
    closers = shut + r")\]’"
    any_ = f"[{STOPS}{INNER}{closers}]"
    last = f"(?:(?<=[{STOPS}{INNER}])(?!{WS}{{1,2}}[{shut}])|(?<=[{STOPS}{INNER}][{closers}]{{1,20}})|(?<={INNER}{WS}{{1,2}}[{shut}]))"
    spaced = f"(?={WS}+(?!{SMALL})[^{WS_CHARS}])"
    # a missing blank: a whole word that goes on neither with a stop nor a bracket, as those of code do
    joined = "(?=\\p{Lu}\\p{Ll}++(?![.(_\\p{L}\\p{N}][\\p{L}\\p{N})]))(?<=[\\p{Ll}\\p{N}%)][\\p{Ll}\\p{N}%)][.!?]{1,3})"
    # scripts without spaces: any stop; a quotation if words before a colon introduce it or, in corner brackets, none attribute it
    goes_on = f"(?=[\\p{{L}}\\p{{N}}{OPEN}])"
    ends = [
        f"{last}(?:{spaced}|{joined})", f"(?<={FULL}[{closers}]{{0,20}})", f"{goes_on}(?<={SAID})",
        f"{goes_on}(?!{_any(QUOTED)})(?<={INNER}{CORNER})", f"(?=[\\p{{Lo}}\\p{{N}}{OPEN}\\p{{Lu}}])(?!{_any(ONWARD)})(?<=\\p{{Lo}}…{{1,3}})",
    ]
    steps.append((None, _mask(f"{any_}(?!{any_})(?:{'|'.join(ends)})", END)))
    # Thai writes no stops: a space between Thai letters parts sentences
    steps.append((_not_ascii, _mask(f"{WS}(?={WS}*[ก-๎])(?<=[ก-๎]{WS})", BREAK)))
    return steps


def masked(df: DataFrame, column: str) -> DataFrame:
    """The text of ``column`` with breaks and end marks in place, each character where it was."""
    for needed, step in _steps():
        s = F.col(column)
        df = df.withColumn(column, step(s) if needed is None else F.when(needed(s), step(s)).otherwise(s))
    return df


def split_sentences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, start_pos, end_pos[, sentence]): positions in code points from 0, end exclusive.

    Units carry no white space at their edges. Blank lines end a unit, headings and list items are
    units, a stop within quotation marks or brackets ends none. NULL, empty and blank texts give no
    rows, nor does an empty table. Rows with the same or no doc_id are split one by one. Texts, lists,
    quotations and brackets may have any length; a quotation or bracket ends in its paragraph.
    """
    t = F.col("__t")
    begun = F.ltrim(F.col("__p"), F.lit(BLANKS))
    lead, body = F.length("__p") - F.length(begun), F.rtrim(begun, F.lit(BLANKS))
    cut = F.split(F.col("__m"), f"(?<=[{BREAK}{END}])")
    rows = df.select(F.col(doc_id).alias("__d"), F.col(text).alias("__t")).filter(t.isNotNull() & (t != "")).withColumn("__r", F.monotonically_increasing_id())
    rows = masked(rows.withColumn("__m", t), "__m")
    parts = rows.select("__r", "__d", *(["__t"] if with_text else []), F.posexplode(cut).alias("__i", "__p"))
    parts = parts.select("__r", "__d", *(["__t"] if with_text else []), "__i", F.length("__p").alias("__n"), lead.alias("__lead"), F.length(body).alias("__len"))
    before = F.sum("__n").over(W.partitionBy("__r").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    start = (before + F.col("__lead")).cast("int")
    got = parts.withColumn("__s", start).filter(F.col("__len") > 0)
    out = [F.col("__d").alias(doc_id), F.col("__s").alias("start_pos"), (F.col("__s") + F.col("__len")).cast("int").alias("end_pos")]
    if with_text:
        out.append(F.substring(F.col("__t"), F.col("__s") + 1, F.col("__len")).alias("sentence"))
    return got.select(*out)
