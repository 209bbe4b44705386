"""SQL for the queries that SQL can express."""

from __future__ import annotations

from faregrid.llm import chat, licenses, secrets, warc


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(place: int, rule: secrets.Rule) -> str:
    pattern = _quote(rule.pattern)
    return f"""
    select rid, {place} as place, '{rule.kind}' as kind, {rule.least} as least, unnest(range(1, len(hits) + 1)) as k, hits, parts, gaps
    from (select rid, regexp_extract_all(text, {pattern}, 0) as hits,
                 regexp_extract_all(text, {pattern}, {rule.group}) as parts,
                 string_split_regex(text, {pattern}) as gaps from t)"""


def secret_scan() -> str:
    base = ", ".join(_quote(r.kind) for r in secrets.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    return f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as ({" union all ".join(_rule(k, r) for k, r in enumerate(secrets.RULES))}),
p as (select rid, place, kind, length(hits[k]) as n,
             list_sum(list_transform(gaps[1:k], lambda x: length(x)))
             + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) as s
      from m where length(parts[k]) >= least),
q as (select rid, {counts},
             string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, place) as spans,
             string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, place)
             filter (kind in ({base})) as base
      from p group by rid)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join q using (rid)"""


def _escaped(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for control in chat.CONTROL:
        out = f"replace({out}, {_quote(control)}, {_quote(control[0] + chr(92) + '.' + control[1:])})"
    return out


def chat_format() -> str:
    text = _quote("</s>[INST] ok [/INST]")
    marks = len(chat.TURN) + len(chat.END) + 2
    return rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', {text} union all select -1, 1, 'assistant', {text})
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = '{chat.LEARNED}'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{chat.LEARNED}'), '')) as loss_sha256,
       sum({marks} + length(replace({_escaped("role")}, chr(10), '\n')) + length({_escaped("text")}))::bigint as formatted_chars
from c group by conv_id"""


def license_scan() -> str:
    """All lines against all statements, without anything dropped before."""
    scan = licenses.Scan()
    values = ", ".join(f"({k}, {_quote(name)}, {_quote(term)}, {n})"
                       for k, (name, counts) in enumerate(scan.statements) for term, n in counts.items())
    top = "(doc_id // 4096) || '/' || (doc_id // 64)"
    return rf"""
with recursive d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
         case when doc_id % 64 = 0 then {top} || '/LICENSE'
              when doc_id % 4 = 0 then {top} || '/' || (doc_id // 4) || '/LICENSE.txt'
              else {top} || '/' || (doc_id // 4) || '/' || doc_id || '.txt' end as path
  from documents),
s(statement, license, term, n) as (values {values}),
l as (select distinct rid, unnest(string_split(lower(text), chr(10))) as line from d),
lines as (select row_number() over () as lid, rid, line from l),
w as (select lid, rid, unnest(regexp_extract_all(line, '{licenses.TERM}')) as term from lines),
idf as (select term, 1 + ln((1 + (select count(*) from d)) / (1 + count(distinct rid))::double) as idf
        from (select distinct term from s) left join w using (term) group by term),
a as (select lid, rid, term, count(*) as n from w group by all),
aw as (select lid, rid, term, a.n * coalesce(idf, 1 + ln((1 + (select count(*) from d))::double)) as weight
       from a left join idf using (term)),
an as (select lid, sqrt(sum(weight * weight)) as size from aw group by lid),
bw as (select statement, license, term, s.n * idf as weight from s join idf using (term)),
bn as (select statement, sqrt(sum(weight * weight)) as size from bw group by statement),
dots as (select lid, rid, statement, license, sum(aw.weight * bw.weight) as dot
         from aw join bw using (term) group by all),
c as (select rid, license, dot / (an.size * bn.size) as cosine
      from dots join an using (lid) join bn using (statement)),
own as (select rid, arg_min(license, (-round(cosine, 9), license)) as own_license, max(round(cosine, 9)) as score
        from c where cosine >= {scan.cosine} group by rid),
f as (select d.*, own_license, score, regexp_replace(path, '/[^/]*$', '') as dir from d left join own using (rid)),
named as (select dir, arg_min(own_license, (-score, own_license, path)) as license,
                 arg_min(path, (-score, own_license, path)) as by_path
          from f where own_license is not null and regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENSE_FILE}')
          group by dir),
above as (select rid, k, array_to_string(string_split(dir, '/')[1:k], '/') as dir
          from (select rid, dir, unnest(range(0, len(string_split(dir, '/')) + 1)) as k from f)),
near as (select rid, arg_max(license, k) as license, arg_max(by_path, k) as by_path
         from above join named using (dir) group by rid)
select doc_id, path, own_license, round(score, 6) as score, coalesce(own_license, license) as license,
       case when own_license is not null then path else by_path end as licensed_by
from f left join near using (rid)"""


def warc_audit(levels: int = 8) -> str:
    """Both trees level by level, and all records compared with each other."""
    def tree(side: str) -> str:
        out = [f"""{side}0 as (
  select file, "offset" // {warc.RANGE_BYTES} as node, min("offset") as a, max("offset" + length) as b, count(*) as n,
         sha256(string_agg("offset" || ':' || length || ':' || digest, chr(10) order by "offset", digest, length)) as hash
  from {side} group by all)"""]
        for k in range(levels):
            out.append(f"""{side}{k + 1} as (
  select file, node // {warc.FANOUT} as node, min(a) as a, max(b) as b, sum(n)::bigint as n,
         sha256(string_agg(node || ':' || a || ':' || b || ':' || hash, chr(10) order by node)) as hash
  from {side}{k} group by file, node // {warc.FANOUT})""")
        roots = " union all ".join(f"select file, n, b, hash, {k + 1} as level from {side}{k + 1}" for k in range(levels))
        return ",\n".join([*out, f"{side}_root as (select * from ({roots}) where level = (select height from h))"])
    head = (r"'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e"
            r" || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e")
    return f"""
with r as (select page_id, printf('pages-%06d.warc', page_id // {warc.FILE_RECORDS}) as file,
                  {head} || coalesce(html, '') || e || e as record
           from pages, (select chr(13) || chr(10) as e)),
o as (select *, strlen(record) as length, coalesce(sum(strlen(record)) over (
        partition by file order by page_id, record rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from r),
ours as (select page_id, file, "offset", length, sha256(record) as digest from o),
theirs as (select page_id, file, "offset", length, sha256(
             case when page_id % 97 = 13 then left(record, length(record) - 5) || '~' || right(record, 4) else record end) as digest
           from o where page_id % 193 <> 101),
h as (select greatest(1, ceil(log(max("offset") // {warc.RANGE_BYTES} + 1) / log({warc.FANOUT}) - 1e-9)) as height from o),
{tree("ours")},
{tree("theirs")},
bad as (select ours.file, count(*) as n, string_agg(ours.page_id, ',' order by ours.page_id) as page_ids,
               string_agg(ours."offset", ',' order by ours."offset") as offsets
        from ours left join theirs using (page_id) where theirs.digest is null or theirs.digest <> ours.digest group by 1)
select u.file, u.n as n_records, u.b::bigint as n_bytes, u.hash as our_root, t.hash as their_root,
       u.hash is not distinct from t.hash as intact, coalesce(bad.n, 0) as n_damaged,
       coalesce(page_ids, '') as page_ids, coalesce(offsets, '') as offsets
from ours_root u left join theirs_root t using (file) left join bad using (file)"""


_COPIES = """
  union all
  select vec_id + k * 1000000, label, list_transform(embedding::double[], lambda x, i: x * (1 + (((vec_id * 31 + (i - 1) * 17 + k) % 7) - 3) / 100e0))
  from embeddings, (values (1), (2)) c(k) where k = 1 or vec_id % 5 = 0"""


def near_vectors(more: str = "") -> str:
    """All pairs of a label, and everything that can be reached."""
    return f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings{more}),
pairs as (select a.vec_id, b.vec_id as other from v a join v b
          on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id, vec_id as other from v
          union select r.vec_id, p.other from reach r join pairs p on p.vec_id = r.other),
c as (select vec_id, min(other) as component_id from reach group by 1),
n as (select vec_id, count(*) as n_links from pairs group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from c left join n using (vec_id)"""


def ranked_search() -> str:
    """Every document that holds a term of an item."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')," \
            r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with d as (select row_number() over () as rid, doc_id, {terms} as terms from documents),
held as (select *, len(terms) as n from d where len(terms) > 0),
c as (select count(*) as docs, sum(n)::bigint as terms from held),
post as (select rid, term, count(*) as tf from (select rid, unnest(terms) as term from held) group by all),
df as (select term, count(*) as df from post group by term),
i as (select row_number() over () as place, item_id, {terms} as terms from (select distinct item_id, text from benchmark)),
q as (select place, item_id, term, count(*) as q from (select place, item_id, unnest(terms) as term from i) group by all),
scored as (
  select place, item_id, rid, doc_id,
         sum(q * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
             * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // c.terms))))::bigint as score
  from q join df using (term) join post using (term) join held using (rid) cross join c group by all),
r as (select *, row_number() over (partition by place order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 10"""


def phrase_collocations() -> str:
    """All n-grams of all pieces."""
    return r"""
with d as (select coalesce(lang, 'und') as lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
t as (select lang, sum(len(words))::hugeint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) as phrase
      from w cross join range(1, 6) r(k) where len(words) >= k),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 100),
s as (select *, string_split(phrase, ' ') as words from f where k > 1),
spans as (select lang, a, words, k, i, unnest(range(i + 1, k + 1)) as j from (select *, unnest(range(1, k + 1)) as i from s)),
longer as (select lang, array_to_string(words[i:j], ' ') as phrase, max(a) as most from spans
           where j - i + 1 between 2 and k - 1 group by all),
free as (select s.* from s left join longer using (lang, phrase) where most is null or 100 * most < 100 * a),
cuts as (select lang, phrase, a, words, k, unnest(range(1, k)) as c from free),
c as (select cuts.lang, cuts.phrase, cuts.a, c, x.a as l, y.a as r, n,
             (1000::hugeint * cuts.a * n) // (x.a::hugeint * y.a) as score
      from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(words[1:c], ' ')
           join f y on y.lang = cuts.lang and y.phrase = array_to_string(words[c + 1:cuts.k], ' ')
           join t on t.lang = cuts.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, c) as weakest from c),
o as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from b where weakest = 1)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from o where rank <= 2000"""


ORACLES = {
    "op1_secret_scan": secret_scan(),
    "op3_license_scan": license_scan(),
    "op4_warc_audit": warc_audit(),
    "op7_near_vectors": near_vectors(),
    "near_vectors_with_copies": near_vectors(_COPIES),
    "op8_chat": chat_format(),
    "op12_ranked_search": ranked_search(),
    "op13_phrase_collocations": phrase_collocations(),
}
