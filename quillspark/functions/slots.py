"""What an instruction asks for and what a program does, as a struct of 11 slots.

Both extractors return event_type and event_target (null if unknown) and nine
sorted sets.  Rules are data: a name and the Column predicate that grants it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.similarity import SLOTS
from quillspark.functions.text import (
    all_groups, costume_targets, directional_numbers, first_group, has_any, is_variable_name, let, mask_identifiers, matches,
    named_target, none, normalize_name, normalize_number, numbers, repeat_counts, sorted_set, sound_targets, strip,
)

# A word with letters, and names of such words (no underscores).
_WORD = r"[\p{L}\p{Nl}\p{No}][\p{L}\p{N}]*"
NAME = rf"{_WORD}(?:[ .'\-]{_WORD})*"
END = r"(?:,|\.| then| and|$)"

# Action -> how a program's line begins.
LINE_ACTIONS = {
    "show": ["show"], "hide": ["hide"], "go_to": ["go to x:", "go to ("], "glide": ["glide "], "move": ["move ", "change x by", "change y by"],
    "turn_left": ["turn left"], "turn_right": ["turn right"], "point_direction": ["point in direction"], "point_towards": ["point towards"],
    "say": ["say "], "think": ["think "], "wait": ["wait "], "switch_costume": ["switch costume to"], "switch_backdrop": ["switch backdrop to"],
    "next_costume": ["next costume"], "next_backdrop": ["next backdrop"], "set_variable": ["set "], "change_variable": ["change "],
    "broadcast": ["broadcast "], "play_sound": ["play sound"], "stop_sounds": ["stop all sounds"], "ask": ["ask "],
}

# Phrases of instructions by what they stand for.
PHRASES = {
    "show": ["show up", "shows up", "show me", "show it", "be visible", "is visible", "showing", "appear"],
    "hide": ["hide", "disappear", "invisible", "be hidden"],
    "go_to": ["move to the spot", "moving to the spot", "move it to the spot", "move me to ", "move it to ", "move to x", "go to x", "go to the spot", "go to ", "random spot", "middle of the screen"],
    "move": ["move", "moving", "forward", "backward", "backwards"],
    "turn_left": ["turn left", "rotate left", "counterclockwise"],
    "turn_right": ["turn right", "rotate right", "clockwise"],
    "point_direction": ["point in direction", "point left", "point to the left", "point right", "point to the right", "face to the right", "facing to the right", "face to the left", "facing to the left"],
    "switch_costume": ["change to costume", "change to ", "change the costume to", "change your costume to", "change its costume to", "change my costume to", "change costume to", "switch to the", "switch to costume", "switch costume to", "switch your costume to", "switch its costume to", "switch my costume to"],
    "switch_backdrop": ["change the backdrop to", "switch backdrop to"],
    "change_variable": ["change ", "subtract", "add ", "take away", "decrease", "reduce", "lower ", "move up by", "moving up by", "move down by", "moving down by", "move left by", "moving left by", "move right by", "moving right by", "go down by", "go up by"],
    "play_sound": ["play sound", "play the sound"],
    "broadcast": ["broadcast", "send message", "send out the message", "send out message"],
    "press": ["key", "press", "pressed", "pressing", "hold", "holding", "let go"],
    "change": ["change", "changes", "changed", "switch", "switches", "switching"],
    "forever": ["forever", "over and over", "again and again"],
    "costume_or_backdrop": ["change the costume to", "change your costume to", "change its costume to", "change my costume to", "change costume to", "change to costume", "switch costume to", "change the backdrop to", "change the background to", "switch backdrop to"],
    "along_x": ["move left by", "moving left by", "move right by", "moving right by"],
    "along_y": ["move up by", "moving up by", "move down by", "moving down by", "go up a little bit", "y position"],
}

# What stands before the backdrop that an instruction waits for.
BACKDROP_CHANGES = ["when the backdrop changes to", "when the background changes to", "when we change the backdrop to", "when we change the background to", "backdrop changes to", "background changes to", "backdrop switches to"]

# Patterns that name a key, in quotes or not.
KEY = r'(?:the )?(?:"([^"]+)"|([a-z0-9_ ]+?)) key'
KEY_PATTERNS = [rf"when {KEY} (?:is )?pressed", rf"press(?:ed|ing)? {KEY}", rf"hold(?:ing)? {KEY}", rf"let go of {KEY}"]

# Patterns of an assignment, and of a change by an amount.
ASSIGNMENTS = [
    rf"\bset ({NAME}) to\b", rf"\bmake ({NAME}) zero\b", r"\bmake [^,.]+? zero\b", r"\bupdate [^,.]+ to\b",
    r"\bset [^,.=]+? = [^,.]+? to\b", r"\bmake [^,.]+ equal to\b", r"\bmake [^,.]+ be\b",
]
GOING = r"\b(?:make|set) the [^,.]+ go (?:up|down|left|right) by\b"

# Patterns whose first group names a variable.
VARIABLE_PATTERNS = [
    rf"\bset ({NAME}) to\b", rf"\bchange ({NAME}) by\b", r"\b(?:decrease|reduce|lower) ([^,.]+?) by\b", rf"\btake away [^,.]* from ([^,.]+?){END}",
    r"\bupdate ([^,.]+?) to\b", rf"\bmake ({NAME}) zero\b", r"\bmake ([^,.]+?) zero\b", rf"\bsubtract [^,.]* from ({NAME}){END}",
    r"\bset(?:ting)? the ([^,.]+?) to\b", r"\bset ([^,.=]+? = [^,.]+?) to\b", r"\bmake ([^,.]+?) equal to\b", r"\bmake ([^,.]+?) be\b",
    r"\b(?:make|set) the ([^,.]+?) go (?:up|down|left|right) by\b", rf"\badd [^,.]* to ([^,.]+?){END}",
]


def granted(rules: dict[str, Column]) -> Column:
    """The names whose predicates hold."""
    return F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in rules.items()]))


def _any(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _slots(values: dict[str, Column]) -> Column:
    return F.struct(*[(values[s] if s in SLOTS[:2] else sorted_set(values[s])).alias(s) for s in SLOTS])


def _names(*arrays: Column) -> Column:
    return F.transform(F.concat(*arrays), normalize_name)


def _one(value: Column) -> Column:
    """An array of the value, empty if it's null."""
    return F.array_compact(F.array(value))


def _bound(values: dict[str, Column], body) -> Column:
    """body(struct of the values), each evaluated once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


#: Stands between lines that are searched together; in a line it is blotted out, so that it marks where lines begin.
_MARK, _BLOT = "\ufdd0", "\ufdd1"


def program_slots(lines: Column) -> Column:
    """Slots of a program given as an array of lines (a program in one string is an array of one)."""
    read = {"low": F.transform(lines, lambda x: F.lower(strip(x))), "text": F.lower(F.array_join(lines, "\n"))}
    return _bound(read, lambda r: _program_events(r["low"], r["text"]))


def _program_events(low: Column, text: Column) -> Column:
    first = F.coalesce(F.get(low, F.lit(0)), F.lit(""))
    is_flag = F.startswith(first, F.lit("when @greenflag clicked"))
    is_backdrop = F.startswith(first, F.lit("when backdrop switches to ["))
    is_receive = F.startswith(first, F.lit("when i receive ["))
    is_key = F.contains(first, F.lit(" key pressed"))
    group = lambda pattern: F.nullif(F.regexp_extract(first, pattern, 1), F.lit(""))
    marked = F.concat(F.lit(_MARK), F.array_join(F.transform(low, lambda x: F.translate(x, _MARK, _BLOT)), _MARK))
    return _bound({
        "event": F.when(is_flag, "green_flag").when(is_backdrop, "backdrop_switch").when(is_receive, "receive").when(is_key, "key_pressed").when(F.startswith(first, F.lit("when this sprite clicked")), "sprite_clicked"),
        "target": normalize_name(
            F.when(is_flag, F.lit(None)).when(is_backdrop, group(r"when backdrop switches to \[([^\]]+)\]")).when(is_receive, group(r"when i receive \[([^\]]+)\]")).when(is_key, group(r"when [\[\(]([^\]\)]+?)(?: v)?[\]\)] key pressed"))
        ),
        "is_backdrop": is_backdrop & ~is_flag,
        "is_receive": is_receive,
        "marked": marked,
        "asks": F.filter(low, lambda x: F.contains(x, F.lit("if <")) | F.contains(x, F.lit("wait until <")) | F.startswith(x, F.lit("repeat until"))),
    }, lambda e: _program_names(low, text, e))


def _program_names(low: Column, text: Column, e: Column) -> Column:
    grab = lambda pattern: F.flatten(F.transform(low, lambda x: all_groups(x, pattern)))
    starts = lambda p: F.contains(e["marked"], F.lit(_MARK + p))
    # a switch line names at most one costume or backdrop, a broadcast line one message: the first
    each = lambda only, pattern: F.filter(F.transform(F.filter(low, lambda x: F.startswith(x, F.lit(only))), lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))), lambda x: x.isNotNull())
    named = lambda only, pattern: F.when(~starts(only), none()).otherwise(_names(each(only, pattern)))
    return _bound({
        "counts": F.transform(grab(r"repeat \((-?\d+(?:\.\d+)?)\)"), normalize_number),
        "variables": F.concat(
            _names(grab(r"(?:set|change) \[([^\]]+?) v\]")),
            granted({v: starts(f"set {v} to") | starts(f"change {v} by") for v in ("x", "y", "size", "volume")}),
        ),
        "costumes": named("switch costume to", r"switch costume to \[([^\]]+)\]"),
        "backdrops": F.concat(named("switch backdrop to", r"switch backdrop to \[([^\]]+)\]"), _one(F.when(e["is_backdrop"], e["target"]))),
        "messages": F.concat(named("broadcast ", r"broadcast \(([^)]+)"), _one(F.when(e["is_receive"], e["target"]))),
    }, lambda n: _program_slots(low, text, e, n))


def _program_slots(low: Column, text: Column, e: Column, n: Column) -> Column:
    starts = lambda p: F.contains(e["marked"], F.lit(_MARK + p))
    if_line = lambda *parts: F.exists(e["asks"], lambda x: reduce(lambda a, b: a & b, [F.contains(x, F.lit(p)) for p in parts]))
    known = F.concat(_one(F.nullif(e["target"], F.lit(""))), n["variables"], n["costumes"], n["backdrops"], n["messages"], sound_targets(text))
    conditions = granted({
        "touching": if_line("touching"), "edge": if_line("edge"), "key_pressed": if_line("key (", "pressed?"), "mouse_down": if_line("mouse down?"),
        "random": if_line("pick random"), "answer": if_line("answer"), "equals": if_line("="),
        "greater_than": if_line(" > ") | if_line("> ("), "less_than": if_line(" < ") | if_line("< ("),
    })
    return _slots({
        "event_type": e["event"],
        "event_target": e["target"],
        "action_types": granted({a: _any(*[starts(p) for p in ps]) for a, ps in LINE_ACTIONS.items()}),
        "loop_types": granted({"forever": F.array_contains(low, "forever"), "repeat_until": starts("repeat until"), "repeat": F.size(n["counts"]) > 0}),
        "loop_counts": n["counts"],
        "condition_types": F.when(F.size(e["asks"]) == 0, none()).otherwise(conditions),
        "numeric_values": numbers(mask_identifiers(text, known)),
        "variable_names": n["variables"],
        "costume_names": n["costumes"],
        "backdrop_names": n["backdrops"],
        "broadcast_names": n["messages"],
    })


def _spoken_event(low: Column, trigger: Column) -> Column:
    """Event type of an instruction; the first rule that holds decides."""
    said = lambda *phrases: has_any(trigger, list(phrases))
    return (
        F.when(said("click on this sprite", "click this sprite", "click on the sprite"), "sprite_clicked")
        .when(said("green flag"), "green_flag")
        .when(said("backdrop", "background") & said(*PHRASES["change"]), "backdrop_switch")
        .when(F.contains(low, F.lit("receive")), "receive")
        .when(said(*PHRASES["press"]), "key_pressed")
        .when(said("sprite", "click"), "sprite_clicked")
    )


def _spoken_target(low: Column, trigger: Column, kind: Column) -> Column:
    pressed = F.coalesce(*[F.nullif(first_group(trigger, p, g), F.lit("")) for p in KEY_PATTERNS for g in (1, 2)])
    received = F.nullif(F.regexp_extract(low, r"receive ([a-z0-9_\- !?]+?)(?:,|\.| then| and|$)", 1), F.lit(""))
    return F.when(kind == "backdrop_switch", F.nullif(named_target(trigger, BACKDROP_CHANGES), F.lit(""))).when(kind == "receive", normalize_name(received)).when(kind == "key_pressed", normalize_name(pressed))


def spoken_slots(nl: Column) -> Column:
    """Slots of an instruction in natural language."""
    # each step binds what later ones use more than once
    return let(F.lower(nl), lambda low: _bound({
        "trigger": strip(F.split(low, r"(?U),|\.|\bthen\b", 2)[0]), "costumes": costume_targets(low), "counts": repeat_counts(low), "signed": directional_numbers(low),
    }, lambda r: _bound({"kind": _spoken_event(low, r["trigger"]), **_said(low, r["costumes"])}, lambda e: let(
        _spoken_target(low, r["trigger"], e["kind"]), lambda target: _bound(_spoken_names(low, r["costumes"], e, target), lambda n: _spoken_slots(low, r, e, target, n)),
    ))))


def _said(low: Column, costumes: Column) -> dict[str, Column]:
    """What several slots ask for."""
    has = lambda *phrases: has_any(low, list(phrases))
    return {
        "dressed": F.size(costumes) > 0,
        "once": has("just once", "one time"),
        "twice": has("twice") | (has("one more time") & has("do that again")),
        "centre": has("move to the middle", "middle of the screen"),
        "straight": has("face straight", "point straight"),
        "steps": matches(low, r"\bgo (?:down|up|left|right)\s+-?\d+(?:\.\d+)?\s+steps?\b", "(?U)"),
    }


def _spoken_names(low: Column, costumes: Column, e: Column, target: Column) -> dict[str, Column]:
    has = lambda *phrases: has_any(low, list(phrases))
    match = lambda pattern: matches(low, pattern, "(?U)")
    grab = lambda pattern: all_groups(low, pattern, flags="(?U)")
    variables = F.concat(
        _names(*[grab(p) for p in VARIABLE_PATTERNS], F.when(e["dressed"], none()).otherwise(grab(r"\bchange ([^,.]+?) to\b"))),
        granted({"x": has(*PHRASES["along_x"]) | (e["steps"] & has("go left", "go right")), "y": has(*PHRASES["along_y"]) | (e["steps"] & has("go down", "go up"))}),
        granted({v: (has("set", "change", "make") & match(rf"\b(?:set|change|make)\s+{v}\b")) | match(rf"\bfrom {v}{END}") for v in ("x", "y", "size", "volume")}),
    )
    backdrop = F.when(has(*PHRASES["switch_backdrop"]), F.nullif(F.regexp_extract(low, r"(?:change the backdrop to|switch backdrop to) ([a-z0-9_\-]+)", 1), F.lit("")))
    filled = lambda names: F.filter(F.transform(names, normalize_name), lambda n: n != "")
    return {
        "variables": F.filter(variables, is_variable_name),
        "backdrops": filled(F.concat(_one(F.when(e["kind"] == "backdrop_switch", target)), _names(_one(backdrop)))),
        "messages": filled(F.concat(_one(F.when(e["kind"] == "receive", target)), _names(grab(rf'(?:broadcast|send (?:out )?the message|send out) "?([^",.]+?)"?{END}')))),
        "chosen": filled(costumes),
    }


def _spoken_slots(low: Column, r: Column, e: Column, target: Column, n: Column) -> Column:
    has = lambda *phrases: has_any(low, list(phrases))
    match = lambda pattern: matches(low, pattern, "(?U)")
    counts, dressed, once, twice, centre, straight, steps = r["counts"], *[e[x] for x in ("dressed", "once", "twice", "centre", "straight", "steps")]
    sends = has("send out the message", "send message", "broadcast ")
    pushed = match(r"\bmove (?:down|up|left|right)\b")
    to = match(r"\bchange [^,.]+ to\b")
    loops = granted({"forever": has(*PHRASES["forever"]), "repeat": (F.size(counts) > 0) | once | twice})
    counts = F.concat(counts, granted({"1": once, "2": twice}))
    held = F.when(has("until"), F.array(F.lit("repeat_until"))).when(has("as long as") | (has("keep ") & (F.size(counts) == 0)), F.array(F.lit("forever"))).otherwise(none())
    assigned = _any(to, *[match(p) for p in ASSIGNMENTS])
    changes = (match(rf"\bchange ({NAME}) by\b") | has(*PHRASES["change_variable"]) | match(GOING)) & ~has(*PHRASES["costume_or_backdrop"]) & ~to
    actions = granted({
        "show": (has(*PHRASES["show"]) | match(r"\bshow\b")) & (~sends | has("show up", "show yourself")),
        "hide": has(*PHRASES["hide"]),
        "glide": has("glide"),
        "go_to": has(*PHRASES["go_to"]) | (has("position where x is") & has("y is")) | centre | (match(r"\bx\s*(?:=|is)\s*-?\d") & match(r"\by\s*(?:=|is)\s*-?\d")),
        "move": (has(*PHRASES["move"]) & has("step", "backward", "forward")) | pushed | steps,
        "turn_left": has(*PHRASES["turn_left"]),
        "turn_right": has(*PHRASES["turn_right"]),
        "point_direction": has(*PHRASES["point_direction"]) | straight,
        "point_towards": has("point towards"),
        "say": has("say "),
        "think": has("think "),
        "wait": has("wait"),
        "switch_costume": has(*PHRASES["switch_costume"]) | dressed,
        "switch_backdrop": has(*PHRASES["switch_backdrop"]),
        "next_costume": has("next costume"),
        "next_backdrop": has("next backdrop"),
        "set_variable": assigned & ~dressed,
        "change_variable": changes | pushed | steps,
        "play_sound": has(*PHRASES["play_sound"]),
        "stop_sounds": has("stop all sounds"),
        "broadcast": has(*PHRASES["broadcast"]),
        "ask": has("ask "),
    })
    known = F.concat(_one(F.nullif(target, F.lit(""))), n["variables"], n["chosen"], n["backdrops"], n["messages"], sound_targets(low))
    signed = r["signed"]
    twins = F.transform(F.filter(signed, lambda x: F.startswith(x, F.lit("-"))), lambda x: F.substring(x, F.lit(2), F.char_length(x)))
    values = F.concat(numbers(mask_identifiers(low, known)), granted({"0": centre | straight, "1": once, "2": twice}), signed)
    maybe, mouse = has("if", "until"), has("mouse down")
    clause = F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" if ")) | F.startswith(low, F.lit("if ")) | has("until")
    equal = has("equals", " is not ") | (has(" is ") & ~has(" key is pressed", " key is not pressed"))
    return _slots({
        "event_type": e["kind"],
        "event_target": target,
        "action_types": actions,
        "loop_types": F.concat(loops, held),
        "loop_counts": counts,
        "condition_types": granted({
            "touching": has("touching", "touch "), "edge": has("edge"), "key_pressed": maybe & has("key") & has("pressed", "pressing", "hold", "holding", "let go"),
            "mouse_down": mouse | (has("mouse") & has("until")), "random": maybe & has("random"), "answer": maybe & has("answer"),
            "equals": (clause & equal) | has("costume number"), "greater_than": clause & has("greater than", "more than"), "less_than": clause & has("less than", "smaller than"),
        }),
        "numeric_values": F.array_except(values, twins),
        "variable_names": n["variables"],
        "costume_names": n["chosen"],
        "backdrop_names": n["backdrops"],
        "broadcast_names": n["messages"],
    })
