"""Text and number primitives as Column builders.

White space, letters and digits are Unicode-aware where the analysed texts may
be; classes such as [a-z0-9] stay ASCII.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space as str.strip() and \s of Python understand it, for Java patterns.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Line ends as str.splitlines() sees them.
NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

# Markers from which on a decoded text is trash, and those of a chat.
SPECIAL_MARKERS = ["<|end_of_text|>", "<|begin_of_text|>", "<|endoftext|>", "<|eot_id|>", "<|im_end|>", "<|im_start|>", "<|user|>", "<|assistant|>", "<|system|>", "<|start_header_id|>", "<|end_header_id|>"]
CHAT_MARKERS = [*SPECIAL_MARKERS, "Human:", "Assistant:"]

# Patterns whose first group tells how often something is done.
REPEAT_PATTERNS = [
    r"repeat ([a-z0-9 .-]+?) times",
    r"do this ([a-z0-9 .-]+?) times",
    r"do that ([a-z0-9 .-]+?) times",
    r"do this next thing ([a-z0-9 .-]+?) times",
    r"do all this ([a-z0-9 .-]+)",
    r"do that whole thing ([a-z0-9 .-]+?) times",
    r"do this whole thing ([a-z0-9 .-]+?) times",
    r"play [^,.]+ sound [^,.]*? ([a-z0-9 .-]+?) times",
    r"keep doing this ([a-z0-9 .-]+?) times",
    r"(?:move|turn|glide|wait|say|think|go)\b[^,.]{0,40}\b([a-z0-9 .-]+?) times",
]
NUMBER = r"(-?\d+(?:\.\d+)?)"

# Patterns of moves by an amount, and the sign of their direction.
DIRECTIONS = [
    (rf"(?:move|moving|go|glide)\s+back(?:ward)?s?\s+{NUMBER}\s+steps?", -1),
    (rf"(?:move|moving|go|glide)\s+forward\s+{NUMBER}\s+steps?", 1),
    (rf"(?:move|moving|go)\s+left\s+by\s+{NUMBER}", -1),
    (rf"(?:move|moving|go)\s+left\s+{NUMBER}\s+steps?", -1),
    (rf"(?:move|moving|go)\s+right\s+by\s+{NUMBER}", 1),
    (rf"(?:move|moving|go)\s+right\s+{NUMBER}\s+steps?", 1),
    (rf"(?:move|moving|go)\s+down\s+by\s+{NUMBER}", -1),
    (rf"(?:move|moving|go)\s+down\s+{NUMBER}\s+steps?", -1),
    (rf"(?:move|moving|go)\s+up\s+by\s+{NUMBER}", 1),
    (rf"(?:move|moving|go)\s+up\s+{NUMBER}\s+steps?", 1),
]

# Patterns whose first group names a costume, or a sound.
COSTUME_PATTERNS = [
    r"(?:change the costume to|change (?:its |your |my )?costume to|change costume to)\s+([a-z0-9_\-]+)",
    r"(?:switch (?:its |your |my )?costume to|switch costume to)\s+([a-z0-9_\-]+)",
    r"(?:change it to|switch it to|change to|switch to)\s+([a-z0-9_\-]+)(?:\s+costume)?",
]
SOUND_PATTERNS = [r"play sound \(([^)]+?) v\)", r"play (?:the )?([a-z0-9_\-]+) sound", r"play the sound ([a-z0-9_\-]+)", r"play sound ([a-z0-9_\-]+)"]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda over an array of one binds it.

    Built columns are trees, so a value that is used n times at each of k steps
    would otherwise be written out n ** k times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Trim Unicode white space, as str.strip()."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Trim, and make each run of white space one space, as ' '.join(s.split())."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def lines_of(c: Column) -> Column:
    """str.splitlines() without its blank lines."""
    return F.filter(F.split(c, NEWLINE, -1), lambda x: strip(x) != "")


def words_of(c: Column) -> Column:
    """str.split()."""
    return F.filter(F.split(squeeze(c), " ", -1), lambda x: x != "")


def has_any(text: Column, phrases: list[str]) -> Column:
    """Is any phrase a substring?"""
    # a phrase that holds another one of them tells nothing more
    needed = [p for p in phrases if not any(q in p for q in phrases if q != p)]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in needed])


def required(pattern: str) -> list[str]:
    """Texts that every match of a pattern holds: its literal runs of two characters or more outside of groups."""
    runs, depth = [""], 0
    if "(?i" in pattern:
        return []
    for atom in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|[?*+]|\{[^}]*\}|.", pattern):
        if atom in "()":
            depth += 1 if atom == "(" else -1
            runs.append("")
        elif depth:
            continue
        elif atom == "|":
            return []
        elif atom in "?*+" or (atom[0] == "{" and len(atom) > 1):
            runs[-1:] = [runs[-1][:-1], ""]
        elif len(atom) == 1 and atom not in ".^$":
            runs[-1] += atom
        elif atom[0] == "\\" and not atom[1].isalnum():
            runs[-1] += atom[1]
        else:
            runs.append("")
    return sorted({r for r in runs if len(r) > 1}, key=lambda r: (-len(r), r))


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    """Does the pattern match anywhere?  It is tried only on texts that hold what every match holds."""
    return reduce(lambda a, b: a & b, [*[F.contains(text, F.lit(r)) for r in required(pattern)], text.rlike(flags + pattern)])


def all_groups(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """A group of every match; the pattern is tried only on texts that hold what every match holds."""
    found = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))
    lacking = [~F.contains(text, F.lit(r)) for r in required(pattern)]
    return F.when(reduce(lambda a, b: a | b, lacking), none()).otherwise(found) if lacking else found


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, empty if there is none; tried as all_groups()."""
    found = F.regexp_extract(text, pattern, group)
    lacking = [~F.contains(text, F.lit(r)) for r in required(pattern)]
    return F.when(reduce(lambda a, b: a | b, lacking), "").otherwise(found) if lacking else found


def sorted_set(c: Column) -> Column:
    """Without duplicates and in order (of values that aren't null)."""
    return F.sort_array(F.array_distinct(c))


def normalize_name(c: Column) -> Column:
    """Lower case without outer white space and quotes, inner white space squeezed, every " v" deleted."""
    bare = F.btrim(F.lower(strip(c)), F.lit("\"' "))
    return F.replace(F.regexp_replace(bare, f"{SPACE}+", " "), F.lit(" v"), F.lit(""))


def normalize_number(c: Column) -> Column:
    """A number's canonical string: whole numbers (to 1e-9) as integers, others with at most 6 decimals.

    What isn't a finite number is returned as it is.
    """
    return let(c.cast("string"), _canonical)


def _canonical(text: Column) -> Column:
    f = text.try_cast("double")
    whole = F.rint(f)
    near = F.abs(f - whole) <= F.greatest(F.lit(1e-9), F.lit(1e-9) * F.greatest(F.abs(f), F.abs(whole)))
    integer = F.when(F.abs(whole) < 9e18, whole.cast("bigint").cast("string")).otherwise(whole.try_cast("decimal(38,0)").cast("string"))
    fixed = F.regexp_replace(F.format_string("%.6f", f), r"\.?0+$", "")
    odd = f.isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    return F.when(odd, text).when(near, F.coalesce(integer, text)).otherwise(fixed)


def digit_numbers(text: Column) -> Column:
    """All written numbers, canonical, as a set."""
    return F.array_distinct(F.transform(all_groups(text, NUMBER), normalize_number))


WORD_VALUES = {**{x: i for i, x in enumerate(UNITS)}, **{x: 10 * i + 20 for i, x in enumerate(TENS)}, "a": 1}


def _word_value(w: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in WORD_VALUES.items() for x in pair]), w)


def number_words(text: Column) -> Column:
    """Numbers that runs of number words state ("a" adds one), canonical, as a set."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    # no run begins without one of these words
    begins = F.array(*map(F.lit, [*WORD_VALUES, "hundred"]))
    return let(words, lambda own: F.when(~F.arrays_overlap(own, begins), none()).otherwise(_runs(own)))


def _runs(words: Column) -> Column:
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("now"), F.lit(False).alias("on"), none().alias("out"))

    def step(s: Column, own: Column) -> Column:
        w, value = own["w"], own["value"]
        scaled = F.greatest(F.lit(1), s["now"])
        hundred, thousand = w == "hundred", (w == "thousand") & s["on"]
        goes_on = value.isNotNull() | hundred | thousand
        done = s["total"] + s["now"]
        now = F.when(value.isNotNull(), s["now"] + value).when(hundred, scaled * 100).otherwise(0)
        total = F.when(thousand, s["total"] + scaled * 1000).when(goes_on, s["total"]).otherwise(0)
        out = F.when(~goes_on & s["on"] & (done > 0), F.concat(s["out"], F.array(done.cast("string")))).otherwise(s["out"])
        return F.struct(total.cast("bigint").alias("total"), now.cast("bigint").alias("now"), goes_on.alias("on"), out.alias("out"))

    valued = F.transform(F.concat(words, F.array(F.lit(""))), lambda w: F.struct(w.alias("w"), _word_value(w).alias("value")))
    # between runs nothing changes
    idle = lambda s, own: ~s["on"] & own["value"].isNull() & (own["w"] != "hundred")
    return F.array_distinct(F.aggregate(valued, zero, lambda s, own: F.when(idle(s, own), s).otherwise(step(s, own)), lambda s: s["out"]))


def numbers(text: Column) -> Column:
    return let(text, lambda own: F.array_union(digit_numbers(own), number_words(own)))


def repeat_counts(text: Column) -> Column:
    """Numbers in what says how often something is repeated (text in lower case)."""
    parts = F.concat(*[all_groups(text, p) for p in REPEAT_PATTERNS])
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: numbers(strip(p)))))


def directional_numbers(text: Column) -> Column:
    """Amounts of moves by direction: negative for back, left and down (text in lower case)."""
    signed = lambda sign: lambda x: normalize_number(sign * F.abs(x.cast("double")))
    return F.array_distinct(F.concat(*[F.transform(all_groups(text, p), signed(s)) for p, s in DIRECTIONS]))


def mask_identifiers(text: Column, names: Column) -> Column:
    """Blank every name out of the text, longest first (of equal length, by name); both in lower case."""
    clean = F.array_distinct(F.filter(F.transform(names, normalize_name), lambda n: n != ""))
    ordered = F.array_sort(clean, lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(ordered, text, lambda t, n: F.replace(t, n, F.lit(" ")))


def named_target(text: Column, prefixes: list[str]) -> Column:
    """Name after the first of the prefixes that has one; null if none."""
    def one(prefix: str) -> Column:
        found = first_group(text, rf"{prefix}\s+([^,.]+?)(?:,|\.| and\b| then\b|$)")
        return let(found, lambda name: F.when(name != "", normalize_name(name)))
    return F.coalesce(*[one(p) for p in prefixes])


def costume_targets(text: Column) -> Column:
    said = F.when(~F.contains(text, F.lit(" to")), none()).otherwise(F.concat(*[all_groups(text, p) for p in COSTUME_PATTERNS]))  # all of them hold " to"
    names = F.transform(said, normalize_name)
    return F.array_distinct(F.filter(names, lambda n: ~n.isin("", "the", "it")))


def sound_targets(text: Column) -> Column:
    names = F.transform(F.concat(*[all_groups(text, p) for p in SOUND_PATTERNS]), normalize_name)
    return F.array_distinct(F.filter(names, lambda n: n != ""))


# How a name of no variable begins, and words that none has.
NO_VARIABLE_PREFIXES = ["it ", "the sprite ", "sprite ", "sure ", "if ", "when "]
NO_VARIABLE_WORDS = ["switch", "glide", "wait", "show", "hide", "move", "turn", "point", "play", "ask", "say", "think", "click"]


def is_variable_name(c: Column) -> Column:
    return let(normalize_name(c), _names_variable)


def _names_variable(name: Column) -> Column:
    banned = reduce(lambda a, b: a | b, [F.startswith(name, F.lit(p)) for p in NO_VARIABLE_PREFIXES])
    return (name != "") & ~banned & ~F.arrays_overlap(F.split(name, " "), F.array(*map(F.lit, NO_VARIABLE_WORDS)))


def _quoted(markers: list[str]) -> str:
    return "|".join(f"\\Q{m}\\E" for m in markers)


def strip_special_tokens(c: Column) -> Column:
    """What stands before the earliest special marker."""
    return F.split(c, _quoted(SPECIAL_MARKERS), 2)[0]


def truncate_chat(c: Column) -> Column:
    """What stands before the earliest marker of a chat going on, trimmed; null becomes empty."""
    return strip(F.split(F.coalesce(c, F.lit("")), _quoted(CHAT_MARKERS), 2)[0])


def strip_prompt(full: Column, prompt: Column, marker: str = "<|assistant|>") -> Column:
    """The completion: without the prompt, else what follows the first marker, else all; trimmed."""
    after = F.split(full, _quoted([marker]), 2)
    rest = F.substring(full, F.char_length(prompt) + 1, F.char_length(full))
    return strip(F.when(F.startswith(full, prompt), rest).when(F.contains(full, F.lit(marker)), after[1]).otherwise(full))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Non-blank lines, each squeezed."""
    return F.array_join(F.transform(lines_of(c), squeeze), "\n")


def comparable(c: Column) -> Column:
    """For exact match and token F1: commas and colons become spaces, what isn't ASCII goes."""
    return F.regexp_replace(F.translate(normalize_text(c), "，,:", "   "), r"[^\x00-\x7F]", "")


def text_of(lines_or_text: Column) -> Column:
    """A program's text from its lines."""
    return F.array_join(lines_or_text, "\n")
