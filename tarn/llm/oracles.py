"""SQL that states the whole result of a query on the same tables, for a reader and for the comparison."""

REPEATED_STRINGS = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
    w as (select doc_id, unnest(generate_series(1, octet_length(b) - 399)) as s, b from d where octet_length(b) >= 400),
    h as (select doc_id, s, md5(array_slice(b, s, s + 399)) as m from w),
    r as (select doc_id, s from h where m in (select m from h group by m having count(*) > 1)),
    g as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 400 then 0 else 1 end as new from r),
    i as (select doc_id, s, sum(new) over (partition by doc_id order by s) as run from g),
    x as (select doc_id, run, min(s) as a, max(s) + 399 as e from i group by doc_id, run),
    k as (select doc_id, count(*) as n_spans, sum(e - a + 1) as n_removed, [0] || list(e order by a) as ends, list(a order by a) as starts from x group by doc_id)
    select d.doc_id, octet_length(b) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
           sha256(case when ends is null then b else unhex(array_to_string(list_transform(range(len(ends)), lambda j: hex(array_slice(b, ends[j + 1] + 1, coalesce(starts[j + 1] - 1, octet_length(b))))), '')) end) as kept_sha256
    from d left join k on k.doc_id = d.doc_id"""

QUALITY_RULES = r"""with t as (select doc_id, source, coalesce(text, '') as text from documents),
    w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from t),
    p as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as window_text from (select doc_id, words, unnest(generate_series(1, len(words) - 4)) as i from w)),
    r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, window_text) as n from p) where n > 1),
    c as (select doc_id, cast(sum(least(5, coalesce(following - i, 5))) as bigint) as n_repeat_words from (select doc_id, i, lead(i) over (partition by doc_id order by i) as following from r) group by doc_id),
    f as (select w.doc_id, source, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
          len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join c on c.doc_id = w.doc_id),
    b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f),
    u as (select source, rule, count(*) as n, sum(case when failed then 1.0::double else 0.0::double end) as fails from
          (select source, unnest(['base', 'symbols', 'lines', 'length']) as rule, unnest([base_failed, n_symbols > n_words, n_dup_lines > 0 and 2 * n_dup_lines > n_lines, n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)]) as failed from b where source is not null)
          group by source, rule),
    m as (select rule, count(*) as hosts, sum(n)::double as n, sum(n::double * n) as nn, least(greatest(sum(fails) / sum(n), 1e-6), 1 - 1e-6) as mean, sum(fails * fails / n) as q from u group by rule),
    v as (select *, case when hosts > 1 and n - nn / n > 0 then (q - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / (n - nn / n) else 0 end as between_hosts from m),
    s as (select rule, mean, least(greatest(case when between_hosts > 0 then mean * (1 - mean) / between_hosts - 1 else n end, 1), greatest(n, 1)) as strength from v),
    bad as (select distinct u.source from u join s on s.rule = u.rule where (u.fails + s.mean * s.strength) / (u.n + s.strength) > 0.5)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (source is null or source not in (select source from bad)) as kept from b"""

WARC = """with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex, min(page_id) over (partition by html) as first_id from p),
    n as (select *, list_transform(range(8), lambda k: ('0x' || hex[k * 5 + 1:k * 5 + 5])::integer) as parts from d)
    select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (parts[j // 4 + 1] >> (15 - 5 * (j % 4)) & 31) + 1, 1)), '') as payload_digest,
           case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from n"""

FILTER_AUDIT = r"""with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
    e as (select t, min(doc_id) as first_id from d group by t),
    g as (select doc_id, max((quality = 1)::integer) as good, max((toxic = 1)::integer) as toxic from labels group by doc_id),
    m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
          case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
          + case when 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 2 * length(w.t) then 4 else 0 end
          + case when regexp_matches(w.t, '[#$%&*|]') then 8 else 0 end + case when w.doc_id > first_id then 16 else 0 end as mask
          from w join e on e.t = w.t left join g on g.doc_id = w.doc_id),
    c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
    f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
    o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
          where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s as (select filter_order, unnest(range(1, 6)) as step from o),
    b as (select filter_order, step, substr(filter_order, step::integer, 1) as filter, (1 << (instr('ABCDE', substr(filter_order, step::integer, 1)) - 1))::integer as own,
          list_sum(list_transform(range(1, step), lambda k: (1 << (instr('ABCDE', substr(filter_order, k::integer, 1)) - 1))::integer)) as earlier from s),
    x as (select part, filter_order, step::integer as step, filter,
          sum(case when mask & (own | coalesce(earlier, 0)::integer) = 0 then n else 0 end) as kept,
          sum(case when mask & own > 0 and mask & coalesce(earlier, 0)::integer = 0 then n else 0 end) as removed,
          sum(case when mask & own > 0 and mask & coalesce(earlier, 0)::integer > 0 then n else 0 end) as redundant,
          sum(case when mask = own then n else 0 end) as unique_fails,
          sum(case when mask & own > 0 and mask & coalesce(earlier, 0)::integer = 0 then good else 0 end) as good_lost,
          sum(case when mask & own > 0 and mask & coalesce(earlier, 0)::integer = 0 then toxic else 0 end) as toxic_lost
          from c, b group by part, filter_order, step, filter)
    select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
           toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from x"""

PHRASES = r"""with d as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
    p as (select lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) as piece from d),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
    n as (select lang, sum(len(words))::bigint as n from w group by lang having sum(len(words)) > 0),
    g as (select lang, unnest(words) as gram from w
          union all select lang, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) from w
          union all select lang, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) from w),
    f as (select lang, gram, count(*) as f, string_split(gram, ' ') as parts from g group by lang, gram having count(*) >= 10),
    c as (select lang, gram, f as a, k, array_to_string(parts[:k], ' ') as head, array_to_string(parts[k + 1:], ' ') as tail from f, range(1, 3) r(k) where k < len(parts)),
    s as (select c.lang, c.gram, a, k, x.f as l, y.f as r, (1000000::hugeint * a * a // (x.f::hugeint * y.f))::bigint as score
          from c join f x on x.lang = c.lang and x.gram = head join f y on y.lang = c.lang and y.gram = tail),
    b as (select * from s qualify row_number() over (partition by lang, gram order by score, k) = 1),
    u as (select lang, part, max(f) as longer from (select lang, f, unnest([parts[1] || ' ' || parts[2], parts[2] || ' ' || parts[3]]) as part from f where len(parts) = 3) group by lang, part),
    o as (select b.lang, row_number() over (partition by b.lang order by score desc, a desc, encode(b.gram)) as rank, b.gram as phrase, a, l, r, n, score
          from b join n on n.lang = b.lang left join u on u.lang = b.lang and u.part = b.gram where longer is null or 100 * longer < 50 * a)
    select * from o where rank <= 2000"""
