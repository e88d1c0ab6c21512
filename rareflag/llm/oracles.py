"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS7 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP7 = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORDS7}) w
           from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}),
             {_WORDS7}) w from benchmark),
win as (select distinct item, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
        from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
sizes as (select distinct n from win),
grams as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hit as (select doc_id, grams.n, i, item from grams join win using (n, g)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
its as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items
        from hit group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""

OP1 = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x20\x09-\x0D]+') w
  from documents),
s as (select doc_id, case when len(w) = 1 then [w[1]]
             else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end s from d
      where len(w) > 0),
cls as (select min(doc_id) c, s from (select doc_id, list_sort(s) s from s) group by s),
mem as (select doc_id, c from (select doc_id, list_sort(s) s from s) join cls using (s)),
e as (select c, len(s) n, unnest(s) g from cls),
o as (select a.c x, b.c y from e a join e b on a.g = b.g and a.c < b.c and a.n * 100 >= 80 * b.n
             and b.n * 100 >= 80 * a.n
      group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select x, y from o union select y, x from o),
r(c, comp) as (select c, c from cls union select l.y, r.comp from r join l on l.x = r.c where r.comp < l.y),
low as (select c, min(comp) comp from r group by c)
select d.doc_id, coalesce(len(s.s), 0) n_shingles, coalesce(low.comp, d.doc_id) component_id,
       d.doc_id = coalesce(low.comp, d.doc_id) kept
from d left join s using (doc_id) left join mem using (doc_id) left join low on low.c = mem.c
"""

ORACLES = {"op1_near_dedup": OP1, "op7_decontamination": OP7}

_P2 = """
f as (select doc_id, coalesce(text, '') as txt, text, case
        when doc_id % 1000 = 0 then coalesce(source, 'none') || '/LICENSE'
        when doc_id % 50 = 0 then coalesce(source, 'none') || '/' || (doc_id // 1000) || '/LICENSE'
        else coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 50) || '/f' || doc_id || '.txt'
      end path from documents),
g as (select *, regexp_replace(path, '/?[^/]*$', '') dir, path like '%/LICENSE' is_licence from f)
"""


def _op2() -> str:
    from rareflag.llm.licenses import MIN_COSINE, TEMPLATES
    rows = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    return f"""
with t(template, name, body) as (values {rows}), {_P2},
u as (select doc_id, unit, body from (select doc_id, unnest(string_split(text, chr(10))) body,
        generate_subscripts(string_split(text, chr(10)), 1) unit from g where text is not null)
      union all select doc_id, -unit, trim(body, chr(10)) from (
        select doc_id, unnest(b) body, generate_subscripts(b, 1) unit from (
          select doc_id, string_split_regex(text, '\n(?:[ \t\r]*\n)+') b from g where text is not null))
      where contains(trim(body, chr(10)), chr(10))
      union all select doc_id, 0, text from g where is_licence and text is not null),
uw as (select doc_id, unit, word, count(*) tf from (select doc_id, unit,
        unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) word from u) group by all),
tw0 as (select template, word, count(*) tf from (select template, unnest(regexp_extract_all(lower(body), '[a-z0-9]+'))
        word from t) group by all),
n as (select count(*) total from (select distinct doc_id, unit from uw)),
df as (select word, count(*) df from uw where word in (select word from tw0) group by 1),
idf as (select distinct tw0.word, ln(1 + total / coalesce(df, 1)) idf from tw0 left join df using (word), n),
tw as (select template, word, tf * idf tw, idf from tw0 join idf using (word)),
tn as (select template, sqrt(sum(tw * tw)) tnorm from tw group by 1),
un as (select doc_id, unit, sqrt(sum(pow(tf * coalesce(idf, ln(1.0 + total)), 2))) norm
       from uw left join idf using (word), n group by 1, 2),
c as (select doc_id, unit, template, round(sum(tf * idf * tw) / (any_value(norm) * any_value(tnorm)), 6) cosine
      from uw join tw using (word) join tn using (template) join un using (doc_id, unit) group by 1, 2, 3),
best as (select doc_id, name own, cosine from (select doc_id, template, cosine, row_number() over (
           partition by doc_id order by cosine desc, template) rn from c where cosine >= {MIN_COSINE})
         join t using (template) where rn = 1),
there as (select dir above, own licence from (select dir, own, row_number() over (
           partition by dir order by cosine desc, path, doc_id) rn from g join best using (doc_id) where is_licence)
          where rn = 1),
near as (select doc_id, licence, above from (select doc_id, licence, above, row_number() over (
           partition by doc_id order by len(above) desc) rn
         from g join there on above = '' or dir = above or starts_with(dir, above || '/')) where rn = 1)
select g.doc_id, path, coalesce(own, licence) license, cosine,
       case when own is not null then 'own' when licence is not null then 'inherited' else 'none' end how,
       case when own is null then above end from_dir
from g left join best using (doc_id) left join near using (doc_id)
"""


OP4 = r"""
with u as (select conv_id, turn, conv_id || ':' || turn id, coalesce(text, '') t, coalesce(len(text), 0) n,
                  case when turn >= 2 then conv_id || ':' || (turn - 2) end after
           from conversations where role = 'user'),
r as (select conv_id || ':' || (turn - 1) id, min(coalesce(text, '')) content, count(*) n_results
      from conversations where role = 'assistant' group by 1),
c as (select u.*, case when n % 3 = 0 then 'search' when n % 3 = 1 then 'lookup' else 'translate' end as name,
             case when n % 3 = 0 then '{"limit":' || (n % 50) || ',"query":' || to_json(t) || '}'
                  when n % 3 = 1 then '{' || case when n % 5 > 0 then '"key":' || to_json(t) || ',' else '' end
                       || '"strict":' || case when n % 2 = 0 then 'true' else 'false' end
                       || case when n % 7 = 0 then ',"verbose":1' else '' end || '}'
                  else '{' || case when n % 4 > 0 then '"target":"en",' else '' end || '"text":' || to_json(t) || '}'
             end args,
             after is not null and after not in (select id from u) as lost
      from u),
e as (select *, array_to_string(list_filter([
        case when name = 'lookup' and n % 5 = 0 then 'missing:key' end,
        case when name = 'translate' and n % 4 = 0 then 'missing:target' end,
        case when name = 'search' and (n % 50 < 1 or n % 50 > 40) then 'range:limit' end,
        case when name = 'lookup' and n % 7 = 0 then 'unknown:verbose' end,
        case when lost then 'unknown dependency:' || after end], lambda x: x is not null), ',') errors from c)
select conv_id, id call_id, cast(turn as bigint) pos, name, cast(turn as bigint) as level,
       coalesce(n_results, 0) n_results,
       case when errors <> '' then 'invalid' when n_results is null then 'no result' else 'ok' end status, errors,
       '{"arguments":' || args || ',"depends_on":[' || case when after is not null then '"' || after || '"' else '' end
         || '],"id":"' || id || '","name":"' || name || '"'
         || case when n_results is not null then ',"result":' || to_json(content) else '' end || '}' json
from e left join r using (id)
union all
select null, id, null, null, null, n_results, 'orphan result', '',
       '{"id":"' || id || '","result":' || to_json(content) || '}'
from r where id not in (select id from u)
"""

ORACLES = ORACLES | {"op2_license_scan": _op2(), "op4_tool_calls": OP4}


def _op11(k: int = 16, rounds: int = 3) -> str:
    """Every distance computed; the rounds written out."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as (select vec_id, rid, v, c, d from (select v.vec_id, v.rid, v.v, cen.c, {_D11} d,
           row_number() over (partition by v.rid order by {_D11}, cen.c) rn from v, c{r} cen) where rn = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} as (select c, list(m order by i) m from (select c, i, (s - ((s % n) + n) % n) // n m from (
           select c, i, sum(v[i])::hugeint s, count(*)::hugeint n from a{r}, range(1, 65) t(i) group by c, i)) group by c),
c{r + 1} as (select c{r}.c, coalesce(list_transform(m{r}.m, lambda x: cast(x as bigint)), c{r}.m) m
           from c{r} left join m{r} using (c))""")
    return f"""
with v as materialized (select vec_id, row_number() over () rid,
        list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings
      where len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select cast(row_number() over (order by sha256('1:' || vec_id), v) - 1 as integer) c, v m
       from v qualify c < {k}),{",".join(steps)}
select vec_id, c as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia,
       cast(sum(d) over () as bigint) inertia,
       sha256(array_to_string(list_transform(m, lambda x: cast(x as varchar)), ',')) centroid_sha256
from a{rounds} join c{rounds} using (c)
"""


_D11 = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - cen.m[i]) * (v.v[i] - cen.m[i])))"


OP12 = """
with d as (select doc_id, encode(coalesce(text, '')) b, row_number() over () rid from documents),
h as (select doc_id, rid, hex(b) x, octet_length(b) n from d),
w as (select doc_id, rid, p, substr(x, 2 * p + 1, 100) s from (select *, unnest(range(0, n - 49)) p from h where n >= 50)),
f as (select s, min(doc_id) f from w group by s having count(*) > 1),
g as (select rid, p from w join f using (s) where f < doc_id),
e as (select rid, p, p - max(p) over (partition by rid order by p rows between unbounded preceding and 1 preceding) gap
      from g),
r as (select rid, run, min(p) a, max(p) + 50 z from (select rid, p, sum(case when gap <= 50 then 0 else 1 end)
        over (partition by rid order by p) run from e) group by rid, run),
k as (select rid, a, z, coalesce(lag(z) over (partition by rid order by a), 0) prev,
             row_number() over (partition by rid order by a desc) last from r),
kept as (select rid, sum(z - a) gone, count(*) spans,
                string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' order by a)
                  || any_value(case when last = 1 then substr(x, 2 * z + 1) end) x
         from k join h using (rid) group by rid)
select doc_id, cast(n as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed,
       cast(coalesce(spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept.x, h.x))) kept_sha256
from h left join kept using (rid)
"""


def _f13(c: str) -> str:
    return (f"case when {c} is null then '-' else octet_length(encode(cast({c} as varchar))) || ':' || "
            f"cast({c} as varchar) end")


def _crc_table() -> list[int]:
    """The reflected CRC-32 table, by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _op13() -> str:
    rest = " || ".join(_f13(c) for c in ("source", "lang", "n_chars"))
    leaf = f"sha256({_f13('doc_id')} || {rest} || {_f13('text')})"
    cut = f"sha256({_f13('doc_id')} || {rest} || {_f13('cut')})"
    crc = ("list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ord(ch) as bigint)), "
           f"lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295::bigint)")

    def tree(name: str, base: str) -> str:
        """Levels of every group's tree: (grp, lvl, pos, hash, n)."""
        return f"""
{name} as (
  select grp, 0 lvl, pos, hash, n from {base}
  union all
  select grp, any_value(lvl) + 1, pos // 3, sha256(string_agg(hash, '' order by pos)), (any_value(n) + 2) // 3
  from {name} where n > 1 group by grp, pos // 3)"""

    def path(name: str, levels: str, leaves: str) -> str:
        """Siblings of each leaf at each level: before and after."""
        return f"""
{name} as (select l.grp, l.pos, s.lvl,
   coalesce(string_agg(s.hash, '' order by s.pos) filter (s.pos < l.pos // pow(3, s.lvl)::bigint), '') b,
   coalesce(string_agg(s.hash, '' order by s.pos) filter (s.pos > l.pos // pow(3, s.lvl)::bigint), '') a
  from {leaves} l join {levels} s on s.grp = l.grp and s.n > 1 and s.pos // 3 = l.pos // pow(3, s.lvl + 1)::bigint
  group by 1, 2, 3)"""

    return f"""
with recursive d as (select *, replace(text, chr(10), '') cut, case when source is null then '' else '+' || source end grp
                     from documents),
leaf as (select doc_id, grp, {leaf} hash,
                case when {crc} % 2 = 1 then {cut} else {leaf} end seen from d),
base as (select doc_id, grp, hash, seen, row_number() over (partition by grp order by doc_id nulls first, hash) - 1 pos,
                count(*) over (partition by grp) n from leaf),{tree("lev", "base")},
sub as (select grp, hash from lev where n = 1),
top as (select '' grp, grp name, hash, row_number() over (order by grp) - 1 pos, count(*) over () n from sub),{tree("toplev", "top")},
root as (select hash from toplev where n = 1),{path("p1", "lev", "base")},{path("p2", "toplev", "top")},
steps as (select base.grp, base.pos, p1.lvl, p1.b, p1.a from base join p1 on p1.grp = base.grp and p1.pos = base.pos
  union all select base.grp, base.pos, 1000 + p2.lvl, p2.b, p2.a
  from base join top on top.name = base.grp join p2 on p2.pos = top.pos),
proof as (select grp, pos, list([b, a] order by lvl) st, string_agg(b || a, '' order by lvl) s from steps group by 1, 2)
select doc_id, base.hash leaf, sub.hash subroot, root.hash root, sha256(coalesce(s, '')) proof_sha256,
       coalesce(list_reduce(list_prepend([seen, ''], st), lambda h, x: [sha256(x[1] || h[1] || x[2]), ''])[1], seen) folded_root,
       coalesce(list_reduce(list_prepend([seen, ''], st), lambda h, x: [sha256(x[1] || h[1] || x[2]), ''])[1], seen)
         = root.hash verified
from base join sub using (grp) left join proof on proof.grp = base.grp and proof.pos = base.pos, root
"""


ORACLES = ORACLES | {"op11_centroid_clusters": _op11(), "op12_suffix_dedup": OP12, "op13_merkle_manifest": _op13()}
