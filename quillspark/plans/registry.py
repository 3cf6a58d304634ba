"""Queries by name, and the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.cleanup import postprocess
from quillspark.functions.grammar import accepted, opcode, program_blocks
from quillspark.functions.operands import operand_tree
from quillspark.functions.similarity import SLOTS, token_f1
from quillspark.functions.slots import program_slots, spoken_slots
from quillspark.operators import joins, prompting, retrieval
from quillspark.operators.report import align, compare, evaluate, mismatches, program_alignment, summarize, worst
from quillspark.operators.selection import by_rule, select_candidates, sequence_logprobs
from quillspark.plans.derived import candidates, programs, table, text_pairs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


r6 = lambda c: F.round(c, 6)

PAIRS = """pairs as (
  select conv_id, turn, t2 as pred, text as gold from (
    select *, lead(role) over w as r2, lead(text) over w as t2 from conversations window w as (partition by conv_id order by turn))
  where role = 'user' and r2 = 'assistant')"""
F1 = r"""f as (
  select conv_id, turn,
         list_filter(regexp_split_to_array(pred, '\s+'), lambda x: x <> '') as p,
         list_filter(regexp_split_to_array(gold, '\s+'), lambda x: x <> '') as g from pairs),
s as (select *, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) as n from f),
scored as (select conv_id, turn, case when len(p) = 0 and len(g) = 0 then 1.0 when n = 0 then 0.0 else 2 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) end as f1 from s)"""


@query(f"with {PAIRS}, {F1} select conv_id, turn, round(f1, 6) as f1 from scored")
def token_f1_pairs(spark, d):
    return text_pairs(spark, d).select("conv_id", "turn", r6(token_f1(F.col("pred"), F.col("gold"))).alias("f1"))


@query(f"with {PAIRS}, {F1}, e as (select count(*) as n, avg(case when regexp_replace(pred, '\\s+', ' ', 'g') = regexp_replace(gold, '\\s+', ' ', 'g') then 1.0 else 0.0 end) as exact from pairs) select cast(n as bigint) as examples, round(exact, 6) as exact_match, (select round(avg(f1), 6) from scored) as mean_f1 from e")
def exact_match_summary(spark, d):
    rows = text_pairs(spark, d).withColumns({"f1": token_f1(F.col("pred"), F.col("gold")), "exact": T.squeeze(F.col("pred")) == T.squeeze(F.col("gold"))})
    return rows.agg(F.count(F.lit(1)).alias("examples"), r6(F.avg(F.col("exact").cast("double"))).alias("exact_match"), r6(F.avg("f1")).alias("mean_f1"))


@query("select p_partkey, replace(regexp_replace(lower(trim(p_name || ' v ')), '\\s+', ' ', 'g'), ' v', '') as name from part")
def normalize_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_name(F.concat("p_name", F.lit(" v "))).alias("name"))


@query("select cast(l_discount as varchar) as raw, regexp_replace(printf('%.6f', l_discount), '\\.?0+$', '') as canonical, count(*) as n from lineitem group by 1, 2")
def normalize_numbers(spark, d):
    raw = F.col("l_discount").cast("string")
    return table(spark, d, "lineitem").groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", T.normalize_number(F.col("raw")).alias("canonical"), "n")


def _spelled(n):
    tens, units = F.array(*map(F.lit, T.TENS)), F.array(*map(F.lit, T.UNITS))
    high = F.get(tens, (F.floor(n / 10) - 2).cast("int"))
    return F.when(n < 20, F.get(units, n)).when(n % 10 == 0, high).otherwise(F.concat(high, F.lit(" "), F.get(units, (n % 10).cast("int"))))


@query("select p_partkey, cast(p_size as varchar) || case when p_partkey % 3 = 0 then ',' || cast(100 * p_size as varchar) else '' end as found from part")
def number_words(spark, d):
    size = _spelled(F.col("p_size"))
    said = F.concat(F.lit("move "), size, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" then wait "), F.when(F.col("p_size") == 1, "a").otherwise(size), F.lit(" hundred"))).otherwise(""))
    # twenty three hundred is (20 + 3) * 100
    return table(spark, d, "part").select("p_partkey", F.array_join(T.number_words(said), ",").alias("found"))


@query("select p_partkey, (case when p_partkey % 2 = 0 then '-' else '' end) || cast(p_size as varchar) as found from part")
def directional_numbers(spark, d):
    way = F.when(F.col("p_partkey") % 2 == 0, "move left by ").otherwise("go up ")
    said = F.concat(way, F.col("p_size").cast("string"), F.lit(" steps"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.directional_numbers(said), ",").alias("found"))


# Phrases with "#" for a number, and the repeats, signed amounts, costumes and sounds that they name.
SAID = [
    ("repeat # times", "#", "", "", ""), ("do this # times", "#", "", "", ""), ("do that # times", "#", "", "", ""), ("do this next thing # times", "#", "", "", ""),
    ("do all this # times", "#", "", "", ""), ("do that whole thing # times", "#", "", "", ""), ("do this whole thing # times", "#", "", "", ""),
    ("play the drum sound for # times", "#", "", "", "drum"), ("keep doing this # times", "#", "", "", ""), ("wait # times", "#", "", "", ""),
    ("move backwards # steps", "", "-#", "", ""), ("glide forward # steps", "", "#", "", ""), ("move left by #", "", "-#", "", ""), ("go left # steps", "", "-#", "", ""),
    ("moving right by #", "", "#", "", ""), ("move right # steps", "", "#", "", ""), ("go down by #", "", "-#", "", ""), ("move down -# steps", "", "-#", "", ""),
    ("moving up by #", "", "#", "", ""), ("go up # step", "", "#", "", ""), ("switch costume to cat#", "", "", "cat#", ""), ("change to dog costume", "", "", "dog", ""),
    ("change my costume to owl", "", "", "owl", ""), ("play sound (meow v)", "", "", "", "meow"), ("play sound pop", "", "", "", "pop"), ("say hello", "", "", "", ""),
]


@query("with k(i, repeats, signed, costumes, sounds) as (values " + ", ".join(str((i, *found)) for i, (_, *found) in enumerate(SAID)) + f""")
select p_partkey, replace(repeats, '#', cast(p_size as varchar)) as repeats, replace(signed, '#', cast(p_size as varchar)) as signed,
       replace(costumes, '#', cast(p_size as varchar)) as costumes, sounds
from part join k on p_partkey % {len(SAID)} = i""")
def spoken_phrases(spark, d):
    """What phrases of every kind name, by part."""
    said = F.replace(F.get(F.array(*[F.lit(text) for text, *_ in SAID]), (F.col("p_partkey") % len(SAID)).cast("int")), F.lit("#"), F.col("p_size").cast("string"))
    own = table(spark, d, "part").select("p_partkey", said.alias("_said"))
    readers = {"repeats": T.repeat_counts, "signed": T.directional_numbers, "costumes": T.costume_targets, "sounds": T.sound_targets}
    return own.select("p_partkey", *[F.array_join(read(F.col("_said")), ",").alias(name) for name, read in readers.items()])


PROGRAMS = """li as (
  select l_orderkey, l_partkey, cast(l_quantity as bigint) as q, l_returnflag || ',' || l_linestatus as f, 
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n from lineitem),
p as (
  select l_orderkey as program_id, o_orderpriority as pr, cast(o_custkey % 5 as varchar) as m, f, q, l_partkey, n,
         case f when 'A,F' then 'move (' || q || ') steps' when 'A,O' then 'repeat (' || q || ')' when 'N,F' then 'wait (' || q || ') seconds'
                when 'N,O' then 'say [p' || l_partkey || ']' when 'R,F' then 'change [score v] by (' || q || ')' when 'R,O' then 'end' end as block
  from li join orders on l_orderkey = o_orderkey)"""
DEPTH = PROGRAMS + """,
d as (select *, sum(case f when 'A,O' then 1 when 'R,O' then -1 else 0 end) over (partition by program_id order by n) as depth from p),
ok as (select program_id, pr, min(depth) >= 0 and pr <> '5-LOW' as parse_ok from d group by program_id, pr)"""


@query(f"with {DEPTH} select program_id, parse_ok from ok")
def program_accepts(spark, d):
    own = programs(spark, d).withColumn("code", F.array_join("lines", "\n"))
    return accepted(own, "code").select("program_id", "parse_ok")


@query(f"with {DEPTH} select pr is not null as rated, count(*) as examples, round(avg(case when parse_ok then 1.0 else 0.0 end), 6) as parse_rate from ok group by 1")
def parse_rate(spark, d):
    own = accepted(programs(spark, d).withColumn("code", F.array_join("lines", "\n")), "code")
    return own.groupBy(F.lit(True).alias("rated")).agg(F.count(F.lit(1)).alias("examples"), r6(F.avg(F.col("parse_ok").cast("double"))).alias("parse_rate"))


@query(f"""with {PROGRAMS} select case f when 'A,F' then 'motion_movesteps' when 'A,O' then 'control_repeat' when 'N,F' then 'control_wait' when 'N,O' then 'looks_say' when 'R,F' then 'data_changevariableby' end as opcode, count(*) as n
from p where f <> 'R,O' group by 1""")
def program_block_counts(spark, d):
    own = program_blocks(programs(spark, d).withColumn("code", F.array_join("lines", "\n")), "program_id", "code")
    return own.filter(~F.startswith("opcode", F.lit("event_when"))).groupBy("opcode").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_quantity as bigint) as varchar) as q, cast(l_partkey as varchar) as p, l_linenumber % 6 as m from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case m
  when 0 then '-:-:operator_gt:-;0:OPERAND1:motion_xposition:-;0:OPERAND2:math_number:' || q
  when 1 then '-:-:operator_not:-;0:OPERAND:sensing_touchingobject:-;1:TOUCHINGOBJECTMENU:sensing_touchingobjectmenu:_edge_'
  when 2 then '-:-:operator_equals:-;0:OPERAND1:VARIABLE:Score;0:OPERAND2:operator_length:-;2:STRING:text:p' || p
  when 3 then '-:-:operator_and:-;0:OPERAND1:operator_or:-;0:OPERAND2:-:-;1:OPERAND1:-:-;1:OPERAND2:-:-'
  when 4 then '-:-:operator_contains:-;0:TEXT:text:answer;0:SUBSTRING:text:p' || p
  else '-:-:operator_lt:-;0:OPERAND1:operator_multiply:-;0:OPERAND2:sensing_timer:-;1:NUM1:math_number:' || q || ' ;1:NUM2:math_number:2' end as tree
from c""")
def condition_operands(spark, d):
    """Operand trees of conditions made from order lines."""
    q, p = F.col("l_quantity").cast("bigint").cast("string"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    made = [("(x position) > (", q, ")"), ("not touching (edge v)?",), ("(score) = (length of (", p, "))"), ("left or right and ", p), ("(answer) contains (", p, ")?"), ("(", q, " * 2) < (timer)")]
    text = F.get(F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]) for parts in made]), F.col("l_linenumber") % 6)
    tree = operand_tree(text, variables=F.array(F.lit("Score")))
    shown = lambda n: F.concat_ws(":", *[F.coalesce(n[c].cast("string"), F.lit("-")) for c in ("parent", "input", "opcode", "value")])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform(tree, shown), ";").alias("tree"))


# Lines of every kind that the grammar tells apart, "#" for a number, and what each one is.
LINES = [
    ("say [hi]", "looks_say"), ("say [hi] for (#) seconds", "looks_sayforsecs"), ("think [hm]", "looks_think"), ("think [hm] for (#) seconds", "looks_thinkforsecs"),
    ("switch costume to [c#]", "looks_switchcostumeto"), ("change [score v] by (#)", "data_changevariableby"), ("set [score v] to [#]", "data_setvariableto"),
    ("set [score v] to (#)", "data_setvariableto"), ("point in direction (#)", "motion_pointindirection"), ("set x to (#)", "motion_setx"), ("set y to (#)", "motion_sety"),
    ("change x by (#)", "motion_changexby"), ("change y by (#)", "motion_changeyby"), ("go to (mouse-pointer v)", "motion_goto"), ("go to (random position v)", "motion_goto"),
    ("go to x: (#) y: (-#)", "motion_gotoxy"), ("move (#) steps", "motion_movesteps"), ("glide (#) secs to (c v)", "motion_glideto"), ("glide (1) secs to x: (#) y: (#)", "motion_glidesecstoxy"),
    ("turn left (#) degrees", "motion_turnleft"), ("turn right (#) degrees", "motion_turnright"), ("broadcast [m v]", "event_broadcast"), ("broadcast [m v] and wait", "event_broadcastandwait"),
    ("create clone of [myself]", "control_create_clone_of"), ("delete this clone", "control_delete_this_clone"), ("stop [all v]", "control_stop"), ("stop [me v]", None),
    ("wait (#) seconds", "control_wait"), ("wait until <(timer) > (#)>", "control_wait_until"), ("wait until <key (a v) press>", "rejected"), ("stop all sounds", "sound_stopallsounds"),
    ("play sound (meow v)", "sound_play"), ("play sound (meow v) until done", None), ("hide", "looks_hide"), ("show", "looks_show"), ("ask [age] and wait", "sensing_askandwait"),
    ("forever", "control_forever"), ("forever now", None), ("repeat (#)", "control_repeat"), ("repeat until <mouse down?>", "control_repeat_until"),
    ("repeat until <(a) contains (b)>", "rejected"), ("if <touching (edge v)?> then", "control_if"), ("if on edge, bounce", "rejected"), ("if nothing", "rejected"), ("else", "else"), ("end", "end"),
    ("when @greenFlag clicked", "event_whenflagclicked"), ("when flag clicked", "event_whenflagclicked"), ("when this sprite clicked", "event_whenthisspriteclicked"),
    ("when backdrop switches to [b v]", "event_whenbackdropswitchesto"), ("when (a v) key pressed", "event_whenkeypressed"), ("when [loudness v] > (#)", "event_whengreaterthan"),
    ("when I receive [m v]", "rejected"), ("when it rains", "rejected"), ("dance # times", None),
]


@query("""with k(i, opcode) as (values """ + ", ".join(f"({i}, {repr(code) if code else 'null'})" for i, (_, code) in enumerate(LINES)) + f""")
select l_orderkey, l_linenumber, l_partkey, l_suppkey, opcode from lineitem join k on l_partkey % {len(LINES)} = i""")
def line_opcodes(spark, d):
    """What a program's lines are: one of each kind, by order line."""
    line = F.replace(F.get(F.array(*[F.lit(text) for text, _ in LINES]), (F.col("l_partkey") % len(LINES)).cast("int")), F.lit("#"), F.col("l_quantity").cast("bigint").cast("string"))
    own = table(spark, d, "lineitem").withColumn("_line", line)
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", opcode(F.col("_line")).alias("opcode"))


# Programs, lines between bars and "#" for a number, and whether each one is accepted: what is left open is, an end or else without its block isn't.
SHAPES = [
    ("when flag clicked|forever|move (#) steps|end", True), ("when flag clicked|forever|move (#) steps", True), ("when flag clicked", True), ("", False),
    ("when flag clicked|if <touching (edge v)?> then|hide|else|show|end", True), ("when flag clicked|if <touching (edge v)?> then|hide|else|show|end|end", True),
    ("when flag clicked|if <touching (edge v)?> then|hide|else|show|end|end|end", False), ("when flag clicked|if <mouse down?> then|else|else", False),
    ("when flag clicked|forever|else", False), ("when flag clicked|else", False), ("move (#) steps|when flag clicked", False), ("forever|when flag clicked", False),
    ("when flag clicked|repeat until <mouse down?>|hide|end|end", False), ("when flag clicked|hide|| |when (a v) key pressed|show", True), ("when flag clicked|if on edge, bounce", False),
    ("when flag clicked|dance (#) steps", False), ("when flag clicked|repeat (#)|if <(1) = (#)> then|wait until <(timer) > (#)>|end|end", True), ("end|when flag clicked", False),
    ("when this sprite clicked|repeat (#)|repeat until <not touching (edge v)?>|say [#]|end|end", True), ("when I receive [m v]|hide", False), (" when flag clicked | hide ", True),
]


@query("with k(i, parse_ok) as (values " + ", ".join(f"({i}, {ok})".lower() for i, (_, ok) in enumerate(SHAPES)) + f""")
select o_orderkey, parse_ok from orders join k on o_orderkey % {len(SHAPES)} = i""")
def program_shapes(spark, d):
    """Is a program accepted?  One of each way to nest blocks, by order."""
    code = F.get(F.array(*[F.lit(text.replace("|", "\n")) for text, _ in SHAPES]), (F.col("o_orderkey") % len(SHAPES)).cast("int"))
    own = table(spark, d, "orders").select("o_orderkey", F.replace(code, F.lit("#"), F.col("o_custkey").cast("string")).alias("code"))
    return accepted(own, "code").select("o_orderkey", "parse_ok")


def _side(name: str, cond: str) -> str:
    """A CTE with the slots of the program's lines (or of what is said of them) for which cond holds."""
    some = lambda value: f"list_sort(list_distinct(coalesce(list({value}) filter ({cond}), [])))"
    return f"""{name} as (select program_id, any_value(pr) as pr, any_value(m) as m,
  {some("case f when 'A,F' then 'move' when 'N,F' then 'wait' when 'N,O' then 'say' when 'R,F' then 'change_variable' end")} as actions,
  {some("case f when 'A,O' then 'repeat' end")} as loops,
  {some("case f when 'A,O' then cast(q as varchar) end")} as counts,
  {some("case when f in ('A,F', 'A,O', 'N,F', 'R,F') then cast(q as varchar) when f = 'N,O' then cast(l_partkey as varchar) end")} as nums,
  {some("case f when 'R,F' then 'score' end")} as vars
  from pp group by program_id)"""


def _jac(slot: str) -> str:
    return f"len(list_intersect(a.{slot}, b.{slot})) / nullif(len(list_distinct(list_concat(a.{slot}, b.{slot}))), 0)"


SLOT_ROWS = PROGRAMS + f""",
pp as (select *, max(n) over (partition by program_id) as total, l_partkey % 4 <> 0 as said from p),
{_side("whole", "true")},
{_side("spoken", "said")},
{_side("short", "n < total")}"""
TYPE = "case pr when '1-URGENT' then 'green_flag' when '2-HIGH' then 'sprite_clicked' when '3-MEDIUM' then 'key_pressed' when '4-NOT SPECIFIED' then 'backdrop_switch' else 'receive' end"
TARGET = "case pr when '3-MEDIUM' then 'space' when '4-NOT SPECIFIED' then 'b' || m when '5-LOW' then 'msg' || m end"
SLOT_COLUMNS = f"""program_id, {TYPE} as event_type, {TARGET} as event_target,
  array_to_string(actions, ',') as action_types, array_to_string(loops, ',') as loop_types, array_to_string(counts, ',') as loop_counts, '' as condition_types,
  array_to_string(nums, ',') as numeric_values, array_to_string(vars, ',') as variable_names, '' as costume_names,
  case pr when '4-NOT SPECIFIED' then 'b' || m else '' end as backdrop_names, case pr when '5-LOW' then 'msg' || m else '' end as broadcast_names"""


def _scores(name: str, program: str, other: str, spoken: bool) -> str:
    """A CTE with the slots' scores (in the order of SLOTS) of a program against what is said, or against another program."""
    names = "case when len(a.vars) > 0 then cast(len(b.vars) > 0 as double) when len(b.vars) > 0 then 0.0 end" if spoken else _jac("vars")
    loops = f"{_jac('loops')}, {_jac('counts')}" if spoken else "null, null"
    return f"""{name} as (select program_id, a.pr, [1.0::double, case when a.pr in ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') then 1.0 end, {_jac("actions")}, {loops}, null,
  {_jac("nums")}, {names}, null, case a.pr when '4-NOT SPECIFIED' then 1.0 end, case a.pr when '5-LOW' then 1.0 end] as v
  from {program} a join {other} b using (program_id)),
{name}_mean as (select *, list_sum(list_filter(v, lambda x: x is not null)) / len(list_filter(v, lambda x: x is not null)) as score from {name})"""


SLOT_LIST = "[" + ", ".join(f"'{x}'" for x in SLOTS) + "]"
ALIGNED = SLOT_ROWS + ",\n" + _scores("al", "whole", "spoken", True)


def _joined_slots(side):
    return [F.coalesce(F.col(f"s.{x}"), F.lit(None)).alias(x) if x in SLOTS[:2] else F.array_join(F.col(f"s.{x}"), ",").alias(x) for x in SLOTS]


@query(f"with {SLOT_ROWS} select {SLOT_COLUMNS} from whole")
def pseudocode_slots(spark, d):
    own = programs(spark, d).select("program_id", program_slots(F.col("lines")).alias("s"))
    return own.select("program_id", *_joined_slots("s"))


@query(f"with {SLOT_ROWS} select {SLOT_COLUMNS} from spoken")
def nl_slots(spark, d):
    own = programs(spark, d).select("program_id", spoken_slots(F.col("nl")).alias("s"))
    return own.select("program_id", *_joined_slots("s"))


def _aligned(spark, d):
    return align(programs(spark, d).withColumnRenamed("lines", "pseudocode"))


@query(f"""with {ALIGNED} select program_id, round(score, 6) as alignment_score, len(list_filter(v, lambda x: x < 1)) = 0 as exact_alignment, score >= 0.85 as high_confidence_alignment,
  array_to_string(list_filter(list_transform(range(1, 12), lambda i: case when v[i] < 1 then {SLOT_LIST}[i] end), lambda x: x is not null), ',') as mismatch_slots from al_mean""")
def sac_nl(spark, d):
    return _aligned(spark, d).select("program_id", r6("alignment_score").alias("alignment_score"), "exact_alignment", "high_confidence_alignment", F.array_join("mismatch_slots", ",").alias("mismatch_slots"))


@query(f"""with {ALIGNED}, g as (select {TYPE} as g, * from al_mean), every as (select g as "group", false as is_overall, score, v from g union all select 'overall', true, score, v from g),
means as (select "group", is_overall, count(*) as n, avg(score) as s, avg(cast(len(list_filter(v, lambda x: x < 1)) = 0 as int)) as e, avg(cast(score >= 0.85 as int)) as h from every group by 1, 2),
slots as (select "group", is_overall, {SLOT_LIST}[i] as slot, count(*) as n, count(v[i]) as c, avg(v[i]) as s from every, range(1, 12) as r(i) group by 1, 2, 3)
select "group", is_overall, metric, round(value, 6) as value from (
  select "group", is_overall, 'num_examples' as metric, n::double as value from means union all select "group", is_overall, 'avg_alignment_score', s from means
  union all select "group", is_overall, 'exact_alignment_rate', e from means union all select "group", is_overall, 'high_confidence_rate', h from means
  union all select "group", is_overall, slot || '_avg_score', s from slots where c > 0 union all select "group", is_overall, slot || '_coverage', c / n from slots where c > 0)""")
def sac_summary(spark, d):
    own = _aligned(spark, d).withColumn("event", F.col("pseudo_slots.event_type"))
    return summarize(own, "event").select("group", "is_overall", "metric", r6("value").alias("value"))


@query(f"with {ALIGNED} select program_id, round(score, 6) as alignment_score from al_mean order by round(score, 9), program_id limit 250")
def sac_bottom_k(spark, d):
    # rounded, so that the order of ties doesn't hang on the last bit of a mean
    own = _aligned(spark, d).withColumn("alignment_score", F.round("alignment_score", 9))
    return worst(own, 250, "program_id").select("program_id", r6("alignment_score").alias("alignment_score"))


def _all_but_last(lines):
    return F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.size(lines) - 1))


@query(f"""with {SLOT_ROWS},
{_scores("sp", "short", "whole", False)} select program_id, round(score, 6) as alignment from sp_mean""")
def sac_pseudo(spark, d):
    """Programs without their last line against the whole ones."""
    own = programs(spark, d)
    return own.select("program_id", r6(program_alignment(F.array_join(_all_but_last(F.col("lines")), "\n"), F.array_join("lines", "\n"))).alias("alignment"))


HAT = "case pr when '1-URGENT' then 'when @greenFlag clicked' when '2-HIGH' then 'when this sprite clicked' when '3-MEDIUM' then 'when (space v) key pressed' when '4-NOT SPECIFIED' then 'when backdrop switches to [b' || m || ' v]' else 'when I receive [msg' || m || ' v]' end"


def _repaired(name: str, cond: str) -> str:
    """CTEs with the repaired text of the lines for which cond holds: an end without a block goes, open blocks are closed."""
    return f"""{name}_w as (select *, sum(case f when 'A,O' then 1 when 'R,O' then -1 else 0 end) over (partition by program_id order by n) as s from pp where {cond}),
{name}_l as (select *, least(0, coalesce(min(s) over (partition by program_id order by n rows between unbounded preceding and 1 preceding), 0)) as low from {name}_w),
{name}_t as (select program_id, string_agg(block, chr(10) order by n) filter (not (f = 'R,O' and s < low)) as body, last(s order by n) - least(0, min(s)) as open from {name}_l group by program_id),
{name} as (select program_id, o.pr, {HAT.replace(' m ', ' o.m ').replace('case pr', 'case o.pr')} || coalesce(chr(10) || body, '') || repeat(chr(10) || 'end', coalesce(open, 0)::int) as code
  from (select distinct program_id, pr, m from pp) o left join {name}_t using (program_id))"""


@query(f"with {SLOT_ROWS}, {_repaired('fixed', 'true')} select pr <> '5-LOW' as parse_ok, count(*) as n, sum(length(code))::bigint as chars from fixed group by 1")
def postprocess_programs(spark, d):
    own = programs(spark, d).withColumn("code", postprocess(F.array_join("lines", "\n")))
    return accepted(own, "code").groupBy("parse_ok").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("chars"))


RATES = lambda name: f"round(avg({name}), 6) as {name}_avg, round(avg(cast({name} >= 1 as int)), 6) as {name}_perfect_rate, round(avg(cast({name} >= 0.85 as int)), 6) as {name}_high_rate"
OVERLAP = "coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0)"


@query(f"""with {SLOT_ROWS}, {_repaired("fixed", "n < total")},
golds as (select program_id, {HAT} || chr(10) || string_agg(block, chr(10) order by n) as gold from pp group by program_id, pr, m),
{_scores("sn", "short", "spoken", True)},
{_scores("sp", "short", "whole", False)},
t as (select program_id, pr, code, gold, string_split_regex(code, '\\s+') as p, string_split_regex(gold, '\\s+') as g, sn.score as sac_nl, sp.score as sac_pseudo
  from fixed join golds using (program_id) join (select program_id, score from sn_mean) sn using (program_id) join (select program_id, score from sp_mean) sp using (program_id)),
o as (select *, {OVERLAP} as n from t)
select count(*) as examples, round(avg(cast(code = gold as int)), 6) as exact_match, round(avg(cast(code = gold as int)), 6) as line_exact_match, round(avg(2.0 * n / (len(p) + len(g))), 6) as token_f1,
  round(avg(cast(pr <> '5-LOW' as int)), 6) as vm_parse_rate, {RATES("sac_nl")}, {RATES("sac_pseudo")} from o""")
def evaluate_programs(spark, d):
    """Programs without their last line, repaired, as predictions of the whole ones."""
    own = programs(spark, d).select(F.array_join("lines", "\n").alias("gold"), F.array_join(_all_but_last(F.col("lines")), "\n").alias("prediction"), "nl")
    m = evaluate(compare(own, clean=True))
    return m.select("examples", *[r6(c).alias(c) for c in m.columns if c != "examples"])


@query(f"""with {SLOT_ROWS}, {_repaired("fixed", "n < total")},
golds as (select program_id, {HAT} || chr(10) || string_agg(block, chr(10) order by n) as gold from pp group by program_id, pr, m),
t as (select program_id as "order", code, gold from fixed join golds using (program_id) where code <> gold order by program_id limit 20)
select "order", i::int as i, 'PRED:' as what, md5(code) as text_md5 from t, (select 1 as i) union all select "order", 2::int, 'GOLD:', md5(gold) from t""")
def first_mismatches(spark, d):
    own = programs(spark, d).select(F.col("program_id").alias("order"), "nl", F.array_join("lines", "\n").alias("gold"), postprocess(F.array_join(_all_but_last(F.col("lines")), "\n")).alias("prediction"))
    shown = mismatches(compare(own, parser=False, nl=None), 20)
    both = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(what).alias("what"), F.md5(text).alias("text_md5")) for i, what, text in ((1, "PRED:", "prediction"), (2, "GOLD:", "gold"))])
    return shown.select("order", F.explode(both).alias("x")).select("order", "x.*")


TOKENS = r"unnest(regexp_extract_all(lower(text), '[a-z0-9_]+'))"


@query(f"""with t as (select doc_id, {TOKENS} as token from documents), n as (select greatest(1, count(*)) as n from documents)
select token, count(distinct doc_id) as df, round(ln((1 + (select n from n)) / (1 + count(distinct doc_id))) + 1, 6) as idf from t group by token""")
def tfidf_idf(spark, d):
    idf = retrieval.inverse_document_frequency(table(spark, d, "documents"), "doc_id", "text")
    return idf.select("token", "df", r6("idf").alias("idf"))


@query(f"""with t as (select doc_id, {TOKENS} as token from documents), n as (select greatest(1, count(*)) as n from documents),
idf as (select token, ln((1 + (select n from n)) / (1 + count(distinct doc_id))) + 1 as idf from t group by token),
w as (select doc_id, token, count(*) * any_value(idf) as w from t join idf using (token) group by doc_id, token),
v as (select doc_id, token, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w),
qt as (select item_id, {TOKENS} as token from benchmark),
qw as (select item_id, token, count(*) * any_value(idf) as w from qt join idf using (token) group by item_id, token),
qv as (select item_id, token, w / sqrt(sum(w * w) over (partition by item_id)) as w from qw),
s as (select item_id, doc_id, round(sum(qv.w * v.w), 12) as score from qv join v using (token) group by item_id, doc_id),
a as (select q.item_id, d.doc_id, coalesce(s.score, 0) as score from (select distinct item_id from qv) q cross join documents d left join s on s.item_id = q.item_id and s.doc_id = d.doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id desc) as rank from a)
select item_id, cast(rank as int) as rank, doc_id, round(score, 6) as score from r where rank <= 5""")
def tfidf_topk(spark, d):
    top = retrieval.top_k(table(spark, d, "benchmark"), table(spark, d, "documents"), 5, query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text")
    return top.select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), r6("score").alias("score"))


FEWSHOT = f"""t as (select doc_id, {TOKENS} as token from documents), n as (select greatest(1, count(*)) as n from documents),
idf as (select token, ln((1 + (select n from n)) / (1 + count(distinct doc_id))) + 1 as idf from t group by token),
w as (select doc_id, token, count(*) * any_value(idf) as w from t join idf using (token) group by doc_id, token),
v as (select doc_id, token, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w),
qt as (select item_id, {TOKENS} as token from benchmark),
qw as (select item_id, token, count(*) * any_value(idf) as w from qt join idf using (token) group by item_id, token),
qv as (select item_id, token, w / sqrt(sum(w * w) over (partition by item_id)) as w from qw),
s as (select item_id, doc_id, round(sum(qv.w * v.w), 12) as score from qv join v using (token) group by item_id, doc_id),
a as (select q.item_id, d.doc_id, coalesce(s.score, 0) as score from (select distinct item_id from qv) q cross join documents d left join s on s.item_id = q.item_id and s.doc_id = d.doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id desc) as rank from a),
e as (select item_id, string_agg('Example ' || rank || ':' || chr(10) || 'Natural Language: ' || d.text || chr(10) || 'Pseudocode:' || chr(10) || lang || chr(10) || chr(10), '' order by rank) as shown
  from r join documents d using (doc_id) where rank <= 2 group by item_id)"""


@query(f"""with {FEWSHOT}, q as (select item_id, 'Task: write a program.' || chr(10) || chr(10) || 'One block a line.' || chr(10) || chr(10) || 'Here are some examples:' || chr(10) || chr(10) || shown
  || 'Now the program of this description:' || chr(10) || chr(10) || 'Natural Language: ' || b.text || chr(10) || 'Pseudocode:' || chr(10) as prompt from benchmark b join e using (item_id)),
j as (select item_id, '{{"model":"gpt-5-mini","messages":[{{"role":"user","content":' || to_json(prompt) || '}}],"max_completion_tokens":1500,"reasoning_effort":"medium"}}' as body from q)
select 'nl2program-' || item_id as custom_id, 'POST' as method, length(body)::int as n, md5(body) as body_md5 from j""")
def fewshot_prompts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("nl"), F.col("lang").alias("pseudocode"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("item_id").alias("order"), F.col("text").alias("nl"))
    top = retrieval.top_k(asked, docs, 2, query_id="query", query_text="nl", doc_id="doc_id", doc_text="nl")
    shown = retrieval.examples_of(top, docs, "doc_id", ["nl", "pseudocode"])
    rows = prompting.requests(asked, shown, prefix="nl2program-", url="/v1/chat/completions", model="gpt-5-mini", task="Task: write a program.", syntax="One block a line.", ask="Now the program of this description:")
    return rows.select("custom_id", "method", F.length("body").alias("n"), F.md5("body").alias("body_md5"))


CANDIDATES = """c as (
  select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as i, -((conv_id * 7 + turn * 13) % 11) / 4.0 as lp, ((conv_id * 5 + turn * 3) % 7) / 7.0 as sac, (conv_id + turn) % 3 = 0 as ok
  from conversations where role = 'assistant'),
v as (select *, max(case when ok then 1 else 0 end) over (partition by conv_id) as any_ok from c)"""


@query(f"""with {CANDIDATES} select conv_id, count(*)::int as num_candidates,
  first(i order by lp desc, i)::int as best_likelihood_idx, first(i order by sac desc, i)::int as best_reranked_idx,
  (first(i order by lp desc, i) filter (ok or any_ok = 0))::int as best_parse_likelihood_idx, (first(i order by sac desc, i) filter (ok or any_ok = 0))::int as best_parse_sac_idx, bool_or(ok) as any_parse_ok
from v group by conv_id""")
def select_rules(spark, d):
    own = select_candidates(candidates(spark, d))
    return own.select("conv_id", "num_candidates", "best_likelihood_idx", "best_reranked_idx", "best_parse_likelihood_idx", "best_parse_sac_idx", "any_parse_ok")


@query(f"""with {CANDIDATES}, b as (select conv_id, first(text order by i) as first, first(text order by lp desc, i) as likelihood, first(text order by sac desc, i) as reranked,
  first(text order by lp desc, i) filter (ok or any_ok = 0) as parse_likelihood, first(text order by sac desc, i) filter (ok or any_ok = 0) as parse_sac from v group by conv_id),
u as (unpivot b on first, likelihood, reranked, parse_likelihood, parse_sac into name rule value prediction)
select rule, count(*) as n, sum(length(prediction))::bigint as chars from u group by rule""")
def predictions_by_rule(spark, d):
    own = by_rule(select_candidates(candidates(spark, d)), ["conv_id"])
    return own.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("prediction")).alias("chars"))


@query(f"""with {CANDIDATES}, gold as (select conv_id, first(text order by turn) as gold from conversations where role = 'user' group by conv_id),
b as (select conv_id, first(text order by i) as first, first(text order by lp desc, i) as likelihood, first(text order by sac desc, i) as reranked,
  first(text order by lp desc, i) filter (ok or any_ok = 0) as parse_likelihood, first(text order by sac desc, i) filter (ok or any_ok = 0) as parse_sac from v group by conv_id),
u as (unpivot b on first, likelihood, reranked, parse_likelihood, parse_sac into name rule value prediction),
k as (select rule, regexp_replace(regexp_replace(prediction, '[，,:]', ' ', 'g'), '[^\\x00-\\x7F]', '', 'g') as p, regexp_replace(regexp_replace(coalesce(gold, ''), '[，,:]', ' ', 'g'), '[^\\x00-\\x7F]', '', 'g') as g from u left join gold using (conv_id)),
w as (select rule, list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '') as p, list_filter(string_split_regex(g, '\\s+'), lambda x: x <> '') as g from k),
o as (select *, {OVERLAP} as n from w)
select rule, count(*) as examples, round(avg(cast(p = g as int)), 6) as exact_match, round(avg(case when len(p) + len(g) = 0 then 1.0 else 2.0 * n / (len(p) + len(g)) end), 6) as token_f1 from o group by rule""")
def metrics_by_rule(spark, d):
    """Evaluation of each rule's choice against the conversation's first user turn."""
    own = by_rule(select_candidates(candidates(spark, d)), ["conv_id"])
    users = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("gold"))
    m = evaluate(compare(own.join(users, "conv_id", "left"), nl=None, parser=False), ["rule"])
    return m.select("rule", "examples", r6("exact_match").alias("exact_match"), r6("token_f1").alias("token_f1"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: -abs(x::double))), 4) as logprob_sum, round(list_sum(list_transform(embedding, lambda x: -abs(x::double))) / len(embedding), 4) as logprob_mean from embeddings")
def sequence_logprob(spark, d):
    steps = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    own = table(spark, d, "embeddings").select("vec_id", F.concat(steps, F.array(F.lit(float("-inf")))).alias("t"))
    total, mean = sequence_logprobs(F.col("t"))
    return own.select("vec_id", F.round(total, 4).alias("logprob_sum"), F.round(mean, 4).alias("logprob_mean"))


@query("select d.doc_id, d.source, l.quality, case when l.doc_id is null then cast(d.n_chars as int) else l.toxic end as n_chars from documents d left join labels l using (doc_id)")
def merge_annotations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("int").alias("n_chars"))
    notes = table(spark, d, "labels").select("doc_id", "quality", F.col("toxic").alias("n_chars"), F.col("doc_id").alias("o"))
    return joins.merge_annotations(docs, notes, ["quality", "n_chars"], key="doc_id", order="o").select("doc_id", "source", "quality", "n_chars")


@query("select conv_id, turn from conversations where conv_id not in (select conv_id from conversations where role = 'assistant' and turn % 4 = 1)")
def resume_anti_join(spark, d):
    own = table(spark, d, "conversations")
    done = own.filter("role = 'assistant' AND turn % 4 = 1").select("conv_id")
    return joins.resume(own, done, "conv_id").select("conv_id", "turn")


@query("""select role || case when turn % 3 = 0 then ' twice' else '' end as key, conv_id, turn, case when turn % 5 = 4 then 'ERROR: status 500 {"code":' || turn || '}' when turn % 7 = 6 then 'ERROR: late' else trim(text) end as prediction from conversations""")
def collect_batch(spark, d):
    """Answers with their metadata, of which every third id has two rows: the last one counts."""
    own = table(spark, d, "conversations").withColumn("custom_id", F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("conv_id", "turn")]))
    failed = F.col("turn") % 5 == 4
    answers = own.select("custom_id", F.when((F.col("turn") % 7 == 6) & ~failed, "late").alias("error"), F.when(failed, 500).otherwise(200).alias("status_code"), F.when(failed, F.to_json(F.struct(F.col("turn").alias("code")))).alias("body"), F.col("text").alias("content"))
    meta = own.select("custom_id", F.lit(0).alias("line"), F.struct("conv_id", "turn").alias("order"), F.col("role").alias("key"), "conv_id", "turn")
    again = meta.filter("turn % 3 = 0").withColumns({"line": F.lit(1), "key": F.concat("key", F.lit(" twice"))})
    return joins.collect_responses(answers, meta.unionAll(again), position="line").select("key", "conv_id", "turn", "prediction")


@query(f"""with {PROGRAMS}, c as (select program_id, {HAT} as hat, pr, m, string_agg(block, chr(10) order by n) as body,
  string_agg(case when l_partkey % 4 <> 0 then case f when 'A,F' then 'move ' || q || ' steps' when 'A,O' then 'repeat ' || q || ' times' when 'N,F' then 'wait ' || q || ' seconds' when 'N,O' then 'say p' || l_partkey when 'R,F' then 'change score by ' || q end end, ', ' order by n) as said
  from p group by program_id, pr, m),
x as (select program_id, hat || chr(10) || body as target, '<|system|>' || chr(10) || 'You write programs.' || chr(10) || '<|user|>' || chr(10) ||
  case pr when '1-URGENT' then 'when the green flag is clicked' when '2-HIGH' then 'when you click on this sprite' when '3-MEDIUM' then 'when the space key is pressed' when '4-NOT SPECIFIED' then 'when the backdrop changes to b' || m else 'when i receive msg' || m end
  || coalesce(', ' || said, '') || '.' || chr(10) || '<|assistant|>' || chr(10) as prompt from c)
select program_id, md5(target) as target_md5, md5(prompt) as prompt_md5, md5(prompt || target) as text_md5 from x""")
def sft_rows(spark, d):
    rows = prompting.training_rows(programs(spark, d), "You write programs.", key="program_id", lines="lines")
    return rows.select("program_id", *[F.md5(c).alias(f"{c}_md5") for c in ("target", "prompt", "text")])


@query("select lang, count(*) as n from documents group by lang")
def split_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, md5(text) as kept from documents")
def strip_special_tokens(spark, d):
    marked = F.concat("text", F.element_at(F.array(*map(F.lit, T.SPECIAL_MARKERS)), (F.col("doc_id") % len(T.SPECIAL_MARKERS) + 1).cast("int")), F.lit("junk<|user|>"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_special_tokens(marked)).alias("kept"))


@query("select doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as kept from documents")
def truncate_chat(spark, d):
    marked = F.concat("text", F.element_at(F.array(*map(F.lit, T.CHAT_MARKERS)), (F.col("doc_id") % len(T.CHAT_MARKERS) + 1).cast("int")), F.lit("junk"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate_chat(marked)).alias("kept"))


@query("""select conv_id, turn, '{"model":"gpt-5-mini","messages":[{"role":"user","content":"' || role || '"}],"max_completion_tokens":1500' || case when turn % 2 = 0 then ',"temperature":0.5' else '' end || ',"reasoning_effort":"medium"}' as body from conversations""")
def chat_bodies(spark, d):
    body = prompting.chat_body(F.lit("gpt-5-mini"), F.col("role"), temperature=F.when(F.col("turn") % 2 == 0, F.lit(0.5)))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))
