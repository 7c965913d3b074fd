"""SQL for the decontamination, resampling and conversation queries, each from its definition."""

from __future__ import annotations

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of letters a-z (A-Z made small), digits and everything beyond ASCII.
WORDS = rf"""list_filter(string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

DECONTAMINATION_SQL = rf"""
    with d as (select row_number() over () r, doc_id, {WORDS} w from documents),
    i as (select item_id, {WORDS} w from benchmark),
    starts as (select item_id, w, least(len(w), 10) l, unnest(range(1, len(w) - least(len(w), 10) + 2)) s
               from i where len(w) > 0),
    win as (select distinct item_id, l, array_to_string(w[s:s + l - 1], ' ') t from starts),
    lens as (select distinct l from win),
    places as (select r, w, l, unnest(range(1, len(w) - l + 2)) s from d, lens where len(w) >= l),
    hits as (select distinct r, item_id, s, win.l from places join win
             on win.l = places.l and win.t = array_to_string(w[s:s + places.l - 1], ' ')),
    words as (select distinct r, unnest(range(s, s + l)) p from hits),
    hit as (select r, count(*) n_hit from words group by r),
    items as (select r, count(*) n_items, string_agg(item, ',' order by item) names
              from (select distinct r, item_id::varchar item from hits where item_id is not null)
              group by r)
    select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
           sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join hit using (r) left join items using (r)"""

# The CRC-32 of one byte for each byte, and with it that of a string's bytes.
CRC_TABLE = """crc_table as materialized (
    select list(c order by i) t from (select i, list_reduce(range(8), lambda c, k:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) c
    from (select unnest(range(256)) i)))"""


def crc(text: str) -> str:
    """SQL for the CRC-32 of a string; ``t`` is the table's list."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::bigint"
    return f"""xor(4294967295, list_reduce(
        list_transform(range(octet_length(encode({text}))), lambda k: {byte}),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint))"""


RESAMPLING_SQL = rf"""
    with {CRC_TABLE},
    d as (select row_number() over () r, doc_id, {WORDS} w from documents),
    dw as (select r, unnest(w) w from d),
    tw as (select unnest({WORDS}) w from benchmark),
    vocabulary as (select distinct w from (select w from dw union all select w from tw)),
    hashed as (select w, {crc("w")} % 10000 b from vocabulary, crc_table),
    corpus as (select b, count(*) s from dw join hashed using (w) group by b),
    target as (select b, count(*) n from tw join hashed using (w) group by b),
    sums as (select (select count(*) from dw) as all_s, (select count(*) from tw) as all_t),
    gains as (select b, floor(1000 * ln((coalesce(n, 0) + 1)::double * (all_s + 10000)::double
                  / ((s + 1)::double * (all_t + 10000)::double)))::bigint g
              from corpus left join target using (b), sums),
    weights as (select r, count(*) n, floor(sum(g)::double / count(*))::bigint weight
                from dw join hashed using (w) join gains using (b) group by r),
    noise as (select r, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h
              from d),
    scored as (select r, doc_id, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
                      coalesce(weight, 0)
                      + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296::double)))::bigint score
               from d join noise using (r) left join weights using (r)),
    ranked as (select r, row_number() over (order by score desc, doc_id nulls last) rank
               from scored where n_features >= 20)
    select doc_id, n_features, weight, score,
           case when rank <= 10 * (select count(*) from ranked) // 100 then rank end rank
    from scored left join ranked using (r)"""


def _plus(value: str, cost: str, letter: str) -> str:
    """A cost of nine digits followed by the letters: more cost and a letter in front."""
    return (
        f"(lpad((substr({value}, 1, 9)::int + {cost})::varchar, 9, '0')"
        f" || '{letter}' || substr({value}, 10))"
    )


def _row_choices(state: int) -> str:
    to = 3 if state == 2 else 2
    choices = [
        _plus(f"v{state}", "2", "D"),
        f"case when not forced then {_plus(f'v{to}', '1 + extra', 'R')} end",
    ]
    keeps = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]
    for initial, kept in keeps:
        same = f"not forced and initial = '{initial}'"
        choices.append(f"case when {same} then {_plus(f'v{kept}', 'extra', 'K')} end")
    return f"least({', '.join(choices)})"


def _inserted(state: int) -> str:
    to = 3 if state == 2 else 2
    then = 2 if to == 3 else 3
    one, two = f"b{to}", _plus(f"b{then}", "5", "I")
    return f"least(b{state}, {_plus(one, '5', 'I')}, {_plus(two, '5', 'I')})"


CONVERSATIONS_SQL = rf"""
    with recursive {CRC_TABLE},
    keyed as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
                     coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') name
              from conversations),
    given as (select k.*, {crc("name")} % 20 kind from keyed k, crc_table),
    damaged as (
        select conv_id, turn, case when kind = 4 then 'user' else role end role,
               case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g')
                    else text end text,
               unnest(range(case when kind = 3 then 2 else 1 end)) copy
        from given where kind <> 0),
    seen as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) i,
               row_number() over (partition by conv_id, role, text
                                  order by turn nulls first, copy) > 1 again,
               not regexp_matches(text, '[^\x20\x09-\x0D]') blank,
               not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') cut,
               substr(role, 1, 1) initial
        from damaged),
    rows as (
        select conv_id, i, turn, role, text, initial, blank, again and not blank duplicate,
               cut and not blank and not again truncated, blank or again forced,
               case when cut and not blank and not again then 5 else 0 end extra,
               lag(initial) over (partition by conv_id order by i) || initial meeting
        from seen),
    ends as (select conv_id, max(i) n from rows group by conv_id),
    states as (
        select conv_id, n + 1 i, '000000000' v0, '000000010II' v1, '000000005I' v2, '000000000' v3
        from ends
        union all
        select conv_id, i, {_inserted(0)}, {_inserted(1)}, {_inserted(2)}, {_inserted(3)}
        from (select s.conv_id, s.i - 1 i, {_row_choices(0)} b0, {_row_choices(1)} b1,
                     {_row_choices(2)} b2, {_row_choices(3)} b3
              from states s join rows r
              on r.conv_id is not distinct from s.conv_id and r.i = s.i - 1)),
    best as (select conv_id, substr(v0, 1, 9)::bigint cost, substr(v0, 10) audit
             from states where i = 1),
    letters as (select conv_id, audit, unnest(range(1, length(audit) + 1)) p from best),
    placed as (
        select conv_id, p, audit[p] letter,
               count(*) filter (audit[p] <> 'I') over w i, count(*) filter (audit[p] <> 'D') over w o
        from letters window w as (partition by conv_id order by p)),
    offered as (
        select a.*, r.role, r.text, r.initial from placed a left join rows r
        on a.letter <> 'I' and r.conv_id is not distinct from a.conv_id and r.i = a.i),
    system as (select conv_id, count(*) n from offered
               where letter = 'K' and initial = 's' group by conv_id),
    lines as (
        select o.conv_id, p,
               case when letter = 'K' then role
                    when (o - coalesce(n, 0)) % 2 = 1 then 'user' else 'assistant' end
               || ':' || case when letter = 'I' then '' else text end line
        from offered o left join system s on s.conv_id is not distinct from o.conv_id
        where letter <> 'D'),
    repaired as (select conv_id, string_agg(line, chr(10) order by p) body from lines group by conv_id),
    counts as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
               count_if(blank) blank, count_if(duplicate) duplicate, count_if(truncated) truncated,
               count_if(meeting is not null and meeting not in ('su', 'ua', 'au')) illegal
        from rows group by conv_id),
    ids as (select distinct conv_id from conversations)
    select ids.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank,
           coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
           coalesce(illegal, 0)::bigint illegal, coalesce(cost, 0) "cost", coalesce(audit, '') audit,
           sha256(coalesce(body, '')) repaired_sha256
    from ids
    left join counts c on c.conv_id is not distinct from ids.conv_id
    left join best b on b.conv_id is not distinct from ids.conv_id
    left join repaired p on p.conv_id is not distinct from ids.conv_id"""
