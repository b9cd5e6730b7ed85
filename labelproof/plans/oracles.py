"""The registered queries written a second time, in SQL for DuckDB."""

from __future__ import annotations

from labelproof.functions import refdata as R
from labelproof.functions.codes import LETTER_DIGITS, LETTERS, QR_FIELDS
from labelproof.operators.payload import COMPARISONS, FIELD_PATTERNS, IDENTITY_RULES, STOP_WORDS
from labelproof.operators.reports import PANELS, SECTION_OF
from labelproof.sources import corpus

ORACLES: dict[str, str] = {}
EP, ST = corpus.with_corpus("eparcel"), corpus.with_corpus("startrack")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def decode(col: str, table: dict, default: str = "null") -> str:
    arms = " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items())
    return f"case {col} {arms} else {default} end"


def inside(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


PREFIX = r"regexp_replace(coalesce(raw_value,''), '^(\]C1)?(\]d2)?', '')"
GS = "chr(28)||chr(29)||chr(30)"
NORM = (
    rf"replace(replace(regexp_replace(regexp_replace(translate({PREFIX}, {GS}, '|||'), '\((00|01|91)\)', '\1', 'g'), "
    rf"'\((420|92|8008)\)', '|\1', 'g'), ' ', ''), chr(9), '')"
)
STRIPPED = f"upper(translate({PREFIX}, {GS}||'| ', ''))"
AI91 = r"'(?i)(?:^|\|)91([A-Z0-9]{21,23})(?:\||$)'"
PNAME = decode("product", R.PRODUCTS, q(R.UNKNOWN_PRODUCT))
DEC = rf""", n0 as (select *, {NORM} as norm, {STRIPPED} as stripped from scans_t),
n1 as (select *, replace(norm,'|','') as compact, replace(replace(stripped,'(',''),')','') as bare from n0),
n2 as (select *, regexp_matches(compact,'^00\d{{18}}$') as sscc20, case when regexp_matches(compact,'^00\d{{18}}$') then compact
  when starts_with(norm,'019931265099999891') then split_part(substr(norm,19),'|',1)
  when regexp_matches(norm,{AI91}) then regexp_extract(norm,{AI91},1)
  when starts_with(compact,'01') and strpos(substr(compact,15),'91')>0 then substr(compact, 16+strpos(substr(compact,15),'91')) end as src from n1),
n3 as (select *, coalesce(nullif(regexp_replace(upper(src),'[^A-Z0-9]','','g'),''), case when regexp_matches(compact,'^[A-Z0-9]{{10,30}}$') then compact end) as cl from n2),
n4 as (select *, nullif(case when regexp_matches(cl,'^[A-Z0-9]{{3}}\d{{9}}[A-Z0-9]{{9}}') then left(cl,21) when regexp_matches(cl,'^00\d{{18}}$') then cl
  when regexp_matches(cl,'^[A-Z0-9]{{5}}\d{{9}}[A-Z0-9]{{9}}') then left(cl,23) else cl end,'') as cand from n3),
n5 as (select *, case when length(cand)=21 and regexp_matches(cand,'^[A-Z0-9]{{3}}\d{{9}}[A-Z0-9]{{9}}') then 3
  when length(cand)=23 and regexp_matches(cand,'^[A-Z0-9]{{5}}\d{{9}}[A-Z0-9]{{9}}') then 5 end as m, regexp_matches(cand,'^00\d{{18}}$') as cand20 from n4),
n6 as (select *, case when m is not null then 'eparcel-standard' when cand20 then 'sscc' end as atype,
  case when m is not null then substr(cand, m+10, 5) end as product, case when m is not null then substr(cand, m+15, 2) end as service,
  case when m is not null then substr(cand, m+8, 2) end as acount, case when m is not null then left(cand, m+7) end as consid,
  case when m is not null then substr(cand, m+17, 1) end as paid, case when m is not null then substr(cand, m+18, 1) end as digit,
  case when m is not null then lpad(translate(left(cand, length(cand)-1), '{LETTERS}', '{LETTER_DIGITS}'),22,'0') end as dig22,
  nullif(regexp_extract(replace(stripped,'(00)','00'),'^00(\d{{18}})',1),'') as s18,
  list_filter(string_split(norm,'|'), lambda x: x <> '') as parts,
  (contains(norm,'420') or contains(norm,'8008') or contains(norm,'|92')) as is_dm from n5),
dec as (select *, case when m is not null then cast((10-({corpus.digit_sum('dig22', 22)})%10)%10 as varchar) end as want,
  case when s18 is not null then cast((10-({corpus.digit_sum('s18', 17)})%10)%10 as varchar) end as swant,
  coalesce(substr(list_filter(parts, lambda x: starts_with(x,'420'))[-1],4,4), nullif(regexp_extract(compact,'420(\d{{4}})',1),'')) as postcode,
  coalesce(substr(list_filter(parts, lambda x: starts_with(x,'92'))[-1],3,8), nullif(regexp_extract(compact,'92(\d{{8}})',1),'')) as dpid,
  coalesce(substr(list_filter(parts, lambda x: starts_with(x,'8008'))[-1],5,12), nullif(regexp_extract(compact,'8008(\d{{12}})',1),'')) as stamp,
  regexp_matches(raw_value,'(?i)FNC1|_1|\$') as literal,
  case when not sscc20 then starts_with(compact,'01') end as ai01,
  case when not sscc20 then starts_with(compact,'{corpus.GTIN}') end as gtin,
  case when not sscc20 then case when starts_with(compact,'{corpus.GTIN}') then substr(compact,17,2)='91' else contains(compact,'91') end end as ai91,
  case when cand is not null and atype is null then case when regexp_matches(cand,'^00\d+$') and length(cand)<>20
    then 'SSCC article IDs must be 20 digits including AI 00. Detected length ' || length(cand) || '.'
    else 'Standard eParcel article IDs must be 21 characters for 3-character MLID or 23 characters for 5-character MLID. Detected length ' || length(cand) || '.' end end as reject
  from n6)"""
EPD = EP + DEC
LABEL_CODES = inside(R.label_codes())
FNAME = decode("fproduct", {c: v[0] for c, v in R.FREIGHT_PRODUCTS.items()}, q(R.UNKNOWN_FREIGHT_PRODUCT))
FLABEL = lambda c: decode(c, {k: v[2] for k, v in R.FREIGHT_PRODUCTS.items()})
QTEXT = r"regexp_replace(coalesce(raw_value,''), '^\]Q[0-9]', '')"
STD = ST + rf""", r0 as (select *, {STRIPPED} as stripped, {QTEXT} as qtext from scans_t),
r1 as (select *, replace(replace(stripped,'(',''),')','') as bare from r0),
r2 as (select *, regexp_matches(bare,'^[A-Z0-9]{{4}}\d{{8}}[A-Z0-9]{{3}}\d{{5}}$') as is_fr,
  nullif(regexp_extract(bare,'421(036)(\d{{4}})403([A-Z0-9]{{3}})',3),'') as g_label, nullif(regexp_extract(bare,'421(036)(\d{{4}})403([A-Z0-9]{{3}})',2),'') as g_code,
  nullif(regexp_extract(bare,'^([A-Z0-9]{{3}})(\d{{4}})([A-Z0-9]{{2,3}})$',1),'') as p_label, nullif(regexp_extract(bare,'^([A-Z0-9]{{3}})(\d{{4}})([A-Z0-9]{{2,3}})$',2),'') as p_code,
  nullif(regexp_extract(bare,'^([A-Z0-9]{{3}})(\d{{4}})([A-Z0-9]{{2,3}})$',3),'') as p_depot,
  regexp_matches(bare,'^C\d{{9}}$') as is_atl, length(qtext) >= 290 as is_qr,
  nullif(regexp_extract(replace(stripped,'(00)','00'),'^00(\d{{18}})',1),'') as s18 from r1),
dec as (select *, case when is_fr then substr(bare,13,3) end as fproduct, coalesce(g_label,p_label) as rlabel,
  coalesce(coalesce(g_label,p_label) in {LABEL_CODES}, false) as is_rt,
  case when s18 is not null then cast((10-({corpus.digit_sum('s18', 17)})%10)%10 as varchar) end as swant from r2)"""

# -- sources, admission ----------------------------------------------------------------------
ORACLES["admit_labels"] = EP + """, a as (select *, case when not (file_type='application/pdf' or starts_with(file_type,'image/') or
 regexp_matches(lower(filename),'\\.(pdf|png|jpe?g|webp|bmp)$')) then 'unsupported file type' when file_bytes > 52428800 then 'file too large'
 when page_count > 40 then 'too many pages' when cast(coalesce(pixel_width,0) as bigint)*coalesce(pixel_height,0) > 50000000 then 'image too large' end as r from labels_t),
 b as (select *, case when r is null then row_number() over (partition by batch_id, r is null order by label_id) end as rn from a)
 select label_id, batch_id, case when r is null and rn > 20 then 'beyond batch file limit' else r end as reject_reason from b"""
ORACLES["clean_scans"] = EP + " select label_id, scan_seq, raw_value from scans_t where raw_value <> ''"
ORACLES["route_text_source"] = EP + """, a as (select *, segment_count <= 1 and rotation = 0 and file_type='application/pdf' as t,
 length(regexp_replace(extracted_text,'[^A-Za-z0-9]','','g')) as n from labels_t)
 select label_id, t as use_text_layer, case when t then n else 0 end as useful_chars, not t or n < 80 as needs_ocr from a"""
PAY = EP + """, p0 as (select payload_id, trim(raw_text) as raw_text from payloads_t),
 p1 as (select *, case when json_valid(raw_text) then raw_text when strpos(raw_text,'{') > 0 and contains(raw_text,'}')
  and json_valid(substr(raw_text, strpos(raw_text,'{'), length(raw_text)-strpos(reverse(raw_text),'}')+2-strpos(raw_text,'{')))
  then substr(raw_text, strpos(raw_text,'{'), length(raw_text)-strpos(reverse(raw_text),'}')+2-strpos(raw_text,'{')) end as js from p0),
 pay as (select payload_id, raw_text, js::json as js, raw_text <> '' as provided, regexp_replace(upper(raw_text),'[^A-Z0-9]+','','g') as norm_text from p1)"""
ORACLES["parse_payloads"] = PAY + """ select payload_id, provided, provided and js is null as parse_error, norm_text as normalized_text,
 js->>'$.consignment_id' as consignment_id from pay"""

# -- scans -------------------------------------------------------------------------------------
ORACLES["normalize_scans"] = EPD + " select label_id, scan_seq, norm as normalized, compact from dec"
ORACLES["strip_scans"] = STD + " select label_id, scan_seq, stripped from dec"
ORACLES["classify_scans"] = EP + """, a as (select *, contains(lower(format),'data') or contains(raw_value,'(420)') or contains(raw_value,'8008') or contains(raw_value,'|420') as dm,
 contains(lower(format),'qr') or kind='qr' as qr from scans_t), b as (select *, not dm and not qr and (contains(lower(format),'128') or kind='linear') as lin from a)
 select label_id, scan_seq, dm as is_datamatrix, qr as is_qr, lin as is_linear, case when dm then 'GS1 DataMatrix' when qr then 'QR Barcode' when lin then 'Linear Barcode'
 else coalesce(nullif(format,''),'Barcode') end as scan_kind, case when contains(lower(format),'data') then 'GS1 DataMatrix' when qr then 'QR Barcode'
 when contains(lower(format),'128') or kind='linear' then 'Linear / Code128' else coalesce(nullif(format,''),'barcode') end as display_name from b"""
ROLE = "upper(translate(raw_value,'() ',''))"
ORACLES["scan_roles"] = ST + rf""" select label_id, scan_seq, regexp_matches({ROLE},'^[A-Z0-9]{{4}}\d{{8}}[A-Z0-9]{{3}}\d{{5}}$') or regexp_matches({ROLE},'^00\d{{18}}$') as is_freight,
 regexp_matches({ROLE},'^C\d{{9}}$') as is_atl, regexp_extract({ROLE},'^([A-Z0-9]{{3}})\d{{4}}[A-Z0-9]{{2,3}}$',1) in {LABEL_CODES}
 or regexp_extract({ROLE},'^421036\d{{4}}403([A-Z0-9]{{3}})$',1) in {LABEL_CODES} as is_routing from scans_t"""
ORACLES["dedupe_scans"] = """with s as (select l_orderkey as label_id, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey as scan_seq,
 case when l_linenumber % 2 = 0 then 'JDQ 000' else 'JDQ000' end || cast(l_partkey % 3 as string) as raw_value, case when l_linenumber % 3 = 0 then 'code_128' else '' end as format,
 case when l_partkey % 4 = 0 then cast(l_suppkey as int) end as bar_count, case when l_partkey % 5 = 0 then cast(l_suppkey as int) end as box_x, l_partkey % 11 as o from lineitem),
 g as (select label_id, format as f, replace(raw_value,' ','') as v, min(scan_seq) as s0, arg_min(raw_value, scan_seq) as raw_value, arg_min(o, scan_seq) as o0,
 arg_min(bar_count, scan_seq) filter (where bar_count is not null) as bar_count, arg_min(box_x, scan_seq) filter (where box_x is not null) as box_x,
 arg_min(o, scan_seq) filter (where box_x is not null) as ob from s group by all)
 select label_id, s0 as scan_seq, raw_value, f as format, bar_count, box_x, 'crop-' || coalesce(ob,o0) as source, 'variant-' || coalesce(ob,o0) as variant_label from g"""
ORACLES["decode_articles"] = EPD + f""" select label_id, scan_seq, case when sscc20 then 'GS1-128/SSCC' when contains(norm,'420') or contains(norm,'8008') then 'GS1-DataMatrix-like'
 else 'GS1-128/Article-like' end as symbology_type, ai01 as has_ai01, gtin as has_gtin, ai91 as has_ai91, cand as article_candidate, reject as reject_reason,
 atype as article_type, left(cand, m) as mlid, consid as consignment_id, acount as article_count, product as product_code,
 case when product is not null then {PNAME} end as product_description, service as service_code, paid, digit as check_digit, want as expected_check_digit from dec"""
ORACLES["decode_datamatrix"] = EPD + """ select label_id, scan_seq, is_dm as looks_datamatrix, postcode as dm_postcode, dpid as dm_dpid, stamp as dm_datetime,
 postcode is not null as has_ai420, dpid is not null as has_ai92, stamp is not null as has_ai8008, literal as invalid_literal_separators from dec"""
ORACLES["decode_sscc"] = EPD + """ select label_id, scan_seq, s18 as sscc18, swant = right(s18,1) as valid, left(s18,1) as extension_digit, substr(s18,2,16) as prefix_serial,
 swant as expected, case when s18 is null then 'No AI 00 + 18 digit SSCC found.' when swant = right(s18,1) then 'Valid SSCC check digit.'
 else 'SSCC check digit mismatch. Expected ' || swant || ', got ' || right(s18,1) || '.' end as reason from dec"""
ORACLES["decode_freight"] = STD + f""" select label_id, scan_seq, case when is_fr then bare end as freight_item, case when is_fr then left(bare,4) end as despatch,
 case when is_fr then left(bare,12) end as connote, case when is_fr then substr(bare,5,8) end as sequence, fproduct as product, case when is_fr then {FNAME} end as product_name,
 case when is_fr then substr(bare,16,5) end as item, {FLABEL('fproduct')} as label_code, case when is_fr then bar_count end as bars,
 case when not is_fr then 'Not a StarTrack 20-character freight item barcode.' end as freight_reason from dec"""
ORACLES["decode_routing"] = STD + f""" select label_id, scan_seq, case when is_rt then case when g_label is not null then 'gs1-421-routing' else 'startrack-routing' end end as route_type,
 case when is_rt then rlabel end as label_code, case when is_rt then case when g_label is not null then g_code else p_code end end as postcode,
 case when is_rt then case when g_label is not null then '' else p_depot end end as depot,
 {decode('case when is_rt then rlabel end', {k: '|'.join(v) for k, v in R.label_code_products().items()})} as products,
 case when is_rt then null when g_label is not null then 'Unknown StarTrack GS1 routing label code ' || g_label || '.' when p_label is not null
 then 'Unknown StarTrack routing label code ' || p_label || '.' else 'Not a StarTrack routing barcode.' end as routing_reason from dec"""
ORACLES["decode_atl"] = STD + """ select label_id, scan_seq, case when is_atl then bare end as atl_number, case when is_atl then cast(substr(bare,2) as bigint) end as counter,
 case when not is_atl then 'Not a StarTrack ATL barcode.' end as atl_reason from dec"""
QF = {n: f"trim(substr(qtext,{s},{k}))" for n, s, k in QR_FIELDS}
ORACLES["decode_qr"] = STD + f""" select label_id, scan_seq, case when is_qr then length(qtext) end as length, case when is_qr then
 {decode(QF['productCode'], {c: v[0] for c, v in R.FREIGHT_PRODUCTS.items()}, q(R.UNKNOWN_FREIGHT_PRODUCT))} end as product_name,
 {', '.join(f'case when is_qr then {e} end as {n}' for n, e in QF.items())} from dec"""
ORACLES["distinct_articles"] = EPD + " select label_id, cand as article_id, min(scan_seq) as first_seq, any_value(atype) as article_type from dec where atype is not null group by 1, 2"
ORACLES["article_rejects"] = EPD + " select label_id, cand as candidate, min(scan_seq) as first_seq, any_value(reject) as reason from dec where reject is not null group by 1, 2"
_EXTRA = r"""select '{c}' as carrier, label_id, scan_seq, raw_value, 'Linear / Code128' as display_name from
 (select *, count(*) over (partition by label_id) as n from scans_t) where n > {k} and raw_value <> '' and not (contains(lower(format),'data') or contains(raw_value,'(420)')
 or contains(raw_value,'8008') or contains(raw_value,'|420')) and not (contains(lower(format),'qr') or kind='qr') and (contains(lower(format),'128') or kind='linear')
 and not regexp_matches(replace(raw_value,' ',''), '^(\]C1)?\(?00\)?\d{{18}}$') and not {role}"""
ORACLES["additional_scans"] = (
    f"select * from ({EP} " + _EXTRA.format(c="eparcel", k=2, role=r"regexp_matches(replace(raw_value,' ',''), '^(\]C1)?\(?01\)?')")
    + f") union all select * from ({ST} " + _EXTRA.format(
        c="startrack", k=3,
        role=rf"(regexp_matches({ROLE},'^[A-Z0-9]{{4}}\d{{8}}[A-Z0-9]{{3}}\d{{5}}$') or regexp_matches({ROLE},'^00\d{{18}}$') or regexp_matches({ROLE},'^C\d{{9}}$')"
             rf" or regexp_extract({ROLE},'^([A-Z0-9]{{3}})\d{{4}}[A-Z0-9]{{2,3}}$',1) in {LABEL_CODES} or regexp_extract({ROLE},'^421036\d{{4}}403([A-Z0-9]{{3}})$',1) in {LABEL_CODES})")
    + ")"
)
ORACLES["scan_diagnostics"] = """select l_orderkey as label_id, case when l_linenumber % 3 = 0 then 'datamatrix' else 'linear' end as kind, 'target-' || l_suppkey % 4 as target,
 count(*) as scans, cast(sum(l_partkey % 3) as bigint) as decoded, cast(count_if(l_partkey % 10 = 0) as bigint) as skipped, cast(sum(cast(l_quantity*40 as bigint)) as bigint) as total_ms,
 max(cast(l_quantity*40 as bigint)) as max_ms, cast(count_if(cast(l_quantity*40 as bigint) >= 1000) as bigint) as slow_scans from lineitem group by 1, 2, 3"""
ORACLES["verify_check_digits"] = EP + f""", v as (select label_id, 'article' as kind, article as v, lpad(translate(left(article,length(article)-1),'{LETTERS}','{LETTER_DIGITS}'),22,'0') as d from base
 union all select label_id, 'sscc', '00'||sscc18, lpad(left(sscc18,17),22,'0') from base),
 w as (select *, cast((10-({corpus.digit_sum('d', 22)})%10)%10 as varchar) as e from v)
 select label_id, kind, e as expected, right(v,1) as actual, e = right(v,1) as valid from w"""

# -- text ----------------------------------------------------------------------------------------
ORACLES["merge_text_sources"] = """with s as (select conv_id as label_id, turn as source_ord, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)),1)-1 as line_no from conversations),
 c as (select *, trim(regexp_replace(raw,'\\s+',' ','g')) as line from s), d as (select *, row_number() over (partition by label_id, upper(line) order by source_ord, line_no) as rn from c where line <> '')
 select label_id, source_ord, cast(line_no as int) as line_no, line from d where rn = 1"""
ORACLES["label_lines"] = """with s as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from documents)
 select doc_id, cast(generate_subscripts(ls,1)-1 as int) as pos, unnest(ls) as line from s"""
STATES = f"(?:{'|'.join(R.STATES)})"
OPER = (r"(?i)^(DELIVERY\s+INSTRUCTIONS|Delivery\s+features|Signature\b|Con\s*No\b|Cons\s*No\b|PARCEL\b|AP\s*Article|Postage\s*Paid|Dead\s*weight|Weight\b|Ph\b|PHONE\b)")
DG = (r"(?i)Aviation\s+Security|Dangerous\s+Goods|Declaration|sender acknowledges|sender declares|carried by air|clearing procedures|does not contain|not contain|prohibited goods|explosive|incendiary|criminal offence")
PLINE = rf"\b([A-Z][A-Z\s''-]+?\s+{STATES}\s+\d{{4}})\b"


def clean(x: str) -> str:
    return (rf"trim(regexp_replace(regexp_replace({x}, '(?i)(?:\s{{3,}}|\b(?:The sender acknowledges|and clearing procedures|the article does not contain|prohibited goods)\b).*$', ''),"
            r" '(?i)\s+Declaration$', ''))")


def pos(ls: str, test: str) -> str:
    return f"coalesce(list_position(list_transform({ls}, lambda x: {test}), true), 0)"


def upto(ls: str, test: str, keep: int = 0) -> str:
    p = pos(ls, test)
    return f"case when {p} > 0 then {ls}[1:{p}-1+{keep}] else {ls} end"


TXT = rf""", t0 as (select *, list_filter(list_transform(string_split(extracted_text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from labels_t),
t1 as (select *, array_to_string(ls, chr(10)) as j, {pos('ls', r"regexp_matches(x, '(?i)^\s*(To|Deliver\s*To)\b:?')")} as pt,
 {pos('ls', r"regexp_matches(x, '(?i)^\s*(From|Sender)\b:?')")} as pf, {pos('ls', r"regexp_matches(x, '(?i)Aviation\s+Security.*Dangerous\s+Goods')")} as pd,
 {pos('ls', r"regexp_matches(x, '(?i)Cons\s*No\s*:?\s*$')")} as pc from t0),
t2 as (select *, case when pt > 0 then trim(regexp_replace(ls[pt], '(?i)^\s*(To|Deliver\s*To)\b:?', '')) end as ht, case when pt > 0 then ls[pt+1:] else [] end as bt,
 case when pf > 0 then trim(regexp_replace(regexp_replace(ls[pf], '(?i)^\s*(From|Sender)\b:?', ''), '(?i)Aviation\s+Security.*$', '')) end as hf, case when pf > 0 then ls[pf+1:] else [] end as bf,
 case when pd > 0 then trim(regexp_extract(ls[pd], '(?i)Aviation\s+Security.*')) end as hd, case when pd > 0 then ls[pd+1:] else [] end as bd from t1),
t3 as (select *, {upto('bt', f"regexp_matches(x, '{OPER}') or regexp_matches(x, '(?i)^From\\b|^Sender\\b')")} as bt1,
 list_filter(list_transform({upto('bf', r"regexp_matches(x, '(?i)^AP\s*Article|^Delivery\s*features|^DELIVER\s+TO|^TO\b')")}, lambda x: {clean('x')}), lambda x: x <> '' and not regexp_matches(x, '{DG}')) as bf1,
 {upto('bd', f"regexp_matches(x, '(?i)^AP\\s*Article|^DELIVER\\s+TO|^TO\\b|^SENDER\\b|^FROM\\b') and not regexp_matches(x, '{DG}')")} as bd1 from t2),
tx as (select *, list_filter(list_concat(case when ht <> '' and not regexp_matches(ht, '(?i)^PHONE\b') and not regexp_matches(ht, '{OPER}') then [{clean('ht')}] else [] end,
  list_filter(list_transform(bt1, lambda x: {clean('x')}), lambda x: x <> '' and not regexp_matches(x, '(?i)^PHONE\b'))), lambda x: x <> '') as to_b,
 list_concat(case when pf > 0 and {clean('hf')} <> '' and not regexp_matches({clean('hf')}, '{DG}') then [{clean('hf')}] else [] end, {upto('bf1', f"regexp_matches(x, '(?i){PLINE}')", 1)}) as from_b,
 case when pd > 0 then list_concat([hd], list_filter({upto('bd1', r"regexp_matches(x, '(?i)criminal offence')", 1)}, lambda x: regexp_matches(x, '{DG}'))) else [] end as dg_b,
 list_distinct_first(list_filter(list_transform(ls, lambda x: trim(regexp_replace(regexp_extract(upper(x), '{PLINE}', 1), '\s+', ' ', 'g'))), lambda x: x <> '')) as plines
 from t3)"""
# order-keeping distinct
TXT = TXT.replace("list_distinct_first(", "ordered_distinct(")
MACRO_OPEN, MACRO = "ordered_distinct(", "list_filter({0}, lambda v, i: list_position({0}, v) = i)"


def expand(sql: str) -> str:
    """ordered_distinct(list) -> list without repeats, first occurrence kept."""
    while MACRO_OPEN in sql:
        i = sql.index(MACRO_OPEN)
        depth, j = 1, i + len(MACRO_OPEN)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = sql[:i] + MACRO.format(sql[i + len(MACRO_OPEN):j - 1]) + sql[j:]
    return sql


TXT = expand(TXT)
EPT, STT = EP + TXT, ST + TXT
J = lambda c: f"array_to_string({c}, '|')"
ORACLES["address_blocks"] = EPT + f" select label_id, {J('to_b')} as to_block, {J('from_b')} as from_block from tx"
ORACLES["dg_blocks"] = EPT + f" select label_id, {J('dg_b')} as dg_block from tx"
ORACLES["postcode_lines"] = EPT + f" select label_id, {J('plines')} as postcode_lines from tx"
AID = r"\b(00\d{18}|[A-Z0-9]{3}\d{18}|[A-Z0-9]{5}\d{18})\b"
AIDS = rf""", ai as (select *, flatten(list_transform(list_filter(ls, lambda x: regexp_matches(x, '(?i)(?:AP\s*)?Article\s*Id')),
 lambda x: regexp_extract_all(upper(regexp_replace(x, '(?i)^.*?(?:AP\s*)?Article\s*Id\s*:?\s*', '')), '{AID}', 1))) as prim,
 flatten(list_transform(list_filter(ls, lambda x: not regexp_matches(x, '(?i)(?:AP\s*)?Article\s*Id')), lambda x: list_filter(regexp_extract_all(upper(x), '{AID}', 1),
 lambda y: starts_with(replace(upper(x),' ',''), y) or ends_with(replace(upper(x),' ',''), y)))) as sec from tx),
 fx as (select *, ordered_distinct(case when len(prim) > 0 then prim else sec end) as aids from ai)"""
AIDS = expand(AIDS)
ORACLES["visible_article_ids"] = EPT + AIDS + f" select label_id, {J('aids')} as article_ids from fx"
LASTL = lambda b: f"coalesce(list_filter({b}, lambda x: regexp_matches(x, '\\d{{4}}\\s*$'))[-1], {b}[-1], '')"
PC4 = lambda b: expand(f"ordered_distinct(flatten(list_transform({b}, lambda x: regexp_extract_all(x, '\\b(\\d{{4}})\\b', 1))))")
ORACLES["address_tail"] = EPT + f" select label_id, {LASTL('to_b')} as to_last, {LASTL('from_b')} as from_last, {J(PC4('to_b'))} as postcodes4 from tx"


def first_value(pattern: str) -> str:
    return f"trim(regexp_extract(list_filter(ls, lambda x: regexp_matches(x, '{pattern}'))[1], '{pattern}', 1))"


CONS = (rf"coalesce(nullif({first_value(r'(?i)Con(?:s)?\s*No\s*:?\s*([A-Z0-9]+)')},''), case when pc > 0 and regexp_matches(ls[pc+1], '(?i)^[A-Z0-9]{{6,16}}$') then ls[pc+1] end)")
WEIGHT = (rf"coalesce(nullif({first_value(r'(?i)(?:Dead\s*weight|Weight)\s*([0-9.]+)\s*kg')},''), nullif({first_value(chr(40)+'?i)' + chr(92) + 'b([0-9]+(?:' + chr(92) + '.[0-9]+)?)' + chr(92) + 's*kg' + chr(92) + 'b')},''))")
FACTS = AIDS + rf""", facts as (select *, upper({CONS}) as cons, {WEIGHT} as wt, list_filter(ls, lambda x: regexp_matches(x, '^\d{{4}}$'))[-1] as mmdd,
 case when regexp_matches(upper(j),'EXPRESS\s+POST') then 'Express Post' when regexp_matches(upper(j),'PARCEL\s+POST') then 'Parcel Post' when contains(upper(j),'EPARCEL') then 'eParcel' end as ltype,
 len(dg_b) > 0 or regexp_matches(j,'(?i)dangerous\s+goods') as dg from fx)"""
ORACLES["eparcel_facts"] = EPT + FACTS + rf""" select label_id, ltype as label_type, {J('aids')} as article_ids, coalesce(cons,'') as consignment_ids,
 {first_value(r'(?i)(?:Ph|Phone)\s*:?\s*([0-9 +()-]+)')} as phone, wt as weight, mmdd, dg, regexp_matches(j,'(?i)Postage\s+Paid') as postage_paid, cast(len(ls) as int) as line_count from facts"""
CL = r"(?i)(?:CONNOTE|CON\s*NO|CONSIGNMENT(?:\s+NUMBER)?)"
SFACTS = rf""", f0 as (select *, {pos('ls', r"regexp_matches(x, '(?i)CONNOTE|CON\s*NO|CONSIGNMENT')")} as pn,
 nullif(upper(regexp_replace(regexp_extract(j, '(?i)(?:ARTICLE\s*ID|FREIGHT\s*ITEM(?:\s*ID)?)\s*:?\s*([A-Z0-9\s]{{12,30}})', 1), '\s+', '', 'g')), '') as la,
 list_filter(list_transform(ls, lambda x: upper(replace(x,' ',''))), lambda x: regexp_matches(x, '^[A-Z0-9]{{4}}\d{{8}}[A-Z0-9]{{3}}\d{{5}}$'))[1] as ba from tx),
 f1 as (select *, coalesce(la, ba) as art, case when pn > 0 then list_filter(list_transform(ls[pn:pn+3], lambda x: regexp_extract(upper(x), '\b([A-Z0-9]{{4}}\d{{8}})\b', 1)), lambda x: x <> '')[1] end as near from f0),
 facts as (select *, coalesce(nullif(upper(regexp_extract(j, '{CL}\s*:?\s*([A-Z0-9]{{8,20}})', 1)),''), nullif(upper(regexp_extract(j, '{CL}\s*:?\s*(?:\r?\n|\s{{2,}})([A-Z0-9]{{8,20}})', 1)),''), near,
  case when regexp_matches(art, '^[A-Z0-9]{{4}}\d{{8}}[A-Z0-9]{{3}}\d{{5}}$') then left(art,12) end) as conn,
  nullif(upper(regexp_extract(j, '(?i)\b(TSE|RET|RE2|APT|PRM|FPP|ARL|FPA|EXP)\b', 1)),'') as lcode, nullif(regexp_extract(j, '(?i)\b([0-9]+(?:\.[0-9]+)?)\s*kg\b', 1),'') as wt,
  nullif(regexp_extract(j, '(?i)\b([0-9]+(?:\.[0-9]+)?)\s*m3\b', 1),'') as cube, nullif(upper(regexp_extract(j, '(?i)\b(BAG|CTN|ITM|JIF|PAL|SAT|SKI)\b', 1)),'') as unit,
  regexp_matches(j, '(?i)DANGEROUS\s+GOODS|DG\s*[:-]|AVIATION\s+SECURITY|IATA|UN\s?\d{{4}}') as dg, regexp_matches(j, '(?i)AUTHORITY\s+TO\s+LEAVE|\bATL\b') as atlp,
  {expand("ordered_distinct(list_transform(regexp_extract_all(j, '(?i)" + chr(92) + "b(C" + chr(92) + "d{9})" + chr(92) + "b', 1), lambda x: upper(x)))")} as atls,
  regexp_matches(upper(j), '\bNZ\b') as nz from f1)"""
ORACLES["startrack_facts"] = STT + SFACTS + f""" select label_id, lcode as label_code, conn as connote, coalesce(art,'') as article_ids, wt as weight, cube, unit, dg, atlp as atl_text,
 {J('atls')} as atl_numbers, nz, cast(len(ls) as int) as line_count from facts"""

# -- evidence ------------------------------------------------------------------------------------
PAGE = "pixel_width is not null and coalesce(width_mm,0)=0"
DPI = "cast(floor(least(pixel_width,pixel_height)/(100/25.4)+0.5) as int)"
ORACLES["page_context"] = EP + f" select label_id, pixel_width, {PAGE} as raster, case when {PAGE} then {DPI} end as dpi from labels_t"
XS = """, x0 as (select *, trim(sscc_company_prefix) as p, trim(sscc_extension_digit) as e from labels_t),
 x1 as (select *, regexp_replace(p,'\\D','','g') as dp, regexp_replace(e,'\\D','','g') as de from x0),
 x2 as (select *, case when e='' then '' when starts_with(de,'00') then substr(de,3,1) else left(de,1) end as ext, case when starts_with(dp,'00') then substr(dp,4) else dp end as px from x1),
 xs as (select *, case when e<>'' and ext='' then 'Enter the SSCC extension digit, for example 3 or 003.' else '' end as er from x2)"""
XCOLS = """label_format='sscc' as provided, p as raw, case when p<>'' and px='' then '' else ext end as extensionDigit, case when p='' then '' else px end as companyPrefix,
 case when p='' then er when px='' then 'Enter the GS1 Company Prefix digits, for example 9315345.' when length(px)<4 or length(px)>12 then 'GS1 Company Prefix should usually be 4 to 12 digits.' else er end as reason"""
ORACLES["sscc_expectation"] = EP + XS + f" select label_id, {XCOLS} from xs"
LIN = "(regexp_matches(coalesce(format,''),'(?i)code[_\\s-]?128|gs1') or coalesce(ai91,false))"
DME = "(is_dm or regexp_matches(coalesce(format,''),'(?i)data[_\\s-]?matrix'))"
ORACLES["symbol_presence"] = EPD + f" select label_id, bool_or({LIN}) as linear_present, bool_or({DME}) as dm_present from dec group by 1"
AGG = f""", sc as (select d.*, l.label_format as fmt, raw_value <> '' as filled from dec d join labels_t l using (label_id)),
 art as (select label_id, cand, any_value(atype) as atype, any_value(product) as product, any_value(service) as service, any_value(acount) as acount, any_value(consid) as consid,
  any_value(paid) as paid, any_value(digit) as digit, any_value(want) as want, any_value(m) as m, min(scan_seq) as s0, any_value(fmt) as fmt from sc where filled and atype is not null group by 1, 2),
 ev as (select label_id, count_if(filled) as scan_count, count_if(filled and is_dm) as n_dm, count_if(filled and (is_dm or not sscc20)) as n_gs1,
  count_if(filled and s18 is not null and swant=right(s18,1)) as n_valid, count_if(filled and s18 is not null and swant<>right(s18,1)) as n_invalid,
  count(distinct case when filled and reject is not null then cand end) as n_rej, bool_or({LIN}) as lin, bool_or({DME}) as dme,
  coalesce(list_sort(list(cand) filter (where filled and atype is not null and not is_dm and not sscc20)),[]) as lids, coalesce(list_sort(list(cand) filter (where filled and atype is not null and is_dm)),[]) as dids from sc group by 1),
 av as (select label_id, count_if(atype = case when fmt='sscc' then 'sscc' else 'eparcel-standard' end) as n_art, count_if(atype='eparcel-standard') as n_std,
  bool_or(atype='eparcel-standard' and fmt<>'sscc' and product in ('00065','00068')) as has_ret, bool_or(atype='eparcel-standard' and fmt<>'sscc' and product in ('00096','00087')) as has_exp from art group by 1),
 lab as (select f.*, coalesce(scan_count,0) as scan_count, coalesce(n_dm,0) as n_dm, coalesce(n_gs1,0) as n_gs1, coalesce(n_valid,0) as n_valid, coalesce(n_invalid,0) as n_invalid, coalesce(n_rej,0) as n_rej,
  coalesce(lin,false) as lin, coalesce(dme,false) as dme, coalesce(lids,[]) as lids, coalesce(dids,[]) as dids, coalesce(n_art,0) as n_art, coalesce(n_std,0) as n_std,
  case when label_format='sscc' then 'sscc' when coalesce(has_ret,false) then 'returns' when coalesce(has_exp,false) then 'express-post' when coalesce(n_art,0)>0 then 'parcel-post'
   when contains(coalesce(ltype,''),'Express') then 'express-post' when contains(coalesce(ltype,''),'Parcel') then 'parcel-post' else 'base' end as variant,
  {PAGE} as raster, {DPI} as dpi, to_b as tb, {PC4('list_concat(plines, to_b)')} as pc4 from facts f left join ev using (label_id) left join av using (label_id))"""
EPL = EP + DEC + TXT + FACTS + AGG
ORACLES["eparcel_evidence"] = EPL + """ select label_id, n_gs1 as gs1, n_dm as datamatrix, n_art as articles, n_valid as sscc_valid, n_invalid as sscc_invalid, n_rej as rejects,
 array_to_string(lids,'|') as linear_ids, array_to_string(dids,'|') as dm_ids, lin as linear_present, dme as dm_present, scan_count from lab"""
EP_MODE = "case when n_std>0 or n_dm>0 or n_valid>0 then 'eparcel' else 'unknown' end"
EP_FMT = "case when n_std>0 then 'standard' when n_valid>0 then 'sscc' else 'unknown' end"

# -- eParcel rules: one CASE per rule --------------------------------------------------------------
SUB = f"^[A-Z][A-Z''\\- ]*[A-Z]\\s+({'|'.join(R.STATES)})\\s+\\d{{4}}$"
RULES: list[str] = []


def out(src, rid, sev, cat, status, where="true", idx=False):
    ident = f"'{rid}' || case when n > 1 then '_' || i else '' end" if idx else f"'{rid}'"
    RULES.append(f"select label_id, {ident} as id, '{rid}' as rule_id, '{sev}' as severity, '{cat}' as category, {status} as status from {src} where {where}")


def pf(cond, fail="fail"):
    return f"case when {cond} then 'pass' else '{fail}' end"


def sub_line(col):
    return f"case when trim({col})='' then 'manual_review' when regexp_matches({col},'{SUB}') and not contains({col},',') then 'pass' else 'fail' end"


SIZE = "((abs(width_mm-150)<=8 and abs(height_mm-100)<=8) or (abs(width_mm-100)<=8 and abs(height_mm-150)<=8))"
out("lab", "EP-LAY-01", "WARNING", "label-layout", f"case when coalesce(width_mm,0)=0 or coalesce(height_mm,0)=0 then 'manual_review' when {SIZE} then 'pass' else 'warning' end")
out("lab", "EP-LAY-06", "WARNING", "label-layout", pf("mmdd is not null", "manual_review"))
out("lab", "EP-LAY-07", "ERROR", "address-format", pf("dg", "manual_review"))
out("lab", "EP-TO-01", "ERROR", "address-format", pf("len(to_b)>0", "warning"))
out("lab", "EP-TO-06", "ERROR", "address-format", sub_line(LASTL("to_b")), "len(to_b)>0")
out("lab", "EP-FR-01", "ERROR", "address-format", pf("len(from_b)>0", "warning"))
out("lab", "EP-FR-05", "ERROR", "address-format", sub_line(LASTL("from_b")), "len(from_b)>0")
out("lab", "EP-LIN-01", "CRITICAL", "gs1-128", pf("lin"))
out("lab", "EP-IMG-01", "WARNING", "label-layout", pf("dpi between 200 and 100000", "warning"), "raster")
out("lab", "EP-DM-01", "CRITICAL", "datamatrix", pf("dme"))
out("gs1", "EP-LIN-07", "CRITICAL", "gs1-128", pf("left(compact,16)='0199312650999998'"), "ai01", True)
out("gs1", "EP-LIN-08", "CRITICAL", "gs1-128", pf("coalesce(ai91,false)"), "ai01", True)
out("lab", "EP-LIN-09", "ERROR", "barcode-structure", pf("list_sort(list_distinct(lids)) = list_sort(list_distinct(dids))"), "len(lids)>0 and len(dids)>0")
out("lab", "EP-ART-01", "CRITICAL", "barcode-structure", pf("n_art>0"))
A_OK = "atype='eparcel-standard'"
out("arts", "EP-ART-02", "ERROR", "barcode-structure", "'pass'", A_OK, True)
out("arts", "EP-ART-03", "ERROR", "barcode-structure", "'pass'", A_OK, True)
out("arts", "EP-ART-04", "ERROR", "barcode-structure", pf("cast(acount as int) between 1 and 20"), A_OK, True)
out("arts", "EP-ART-05", "ERROR", "barcode-structure", pf("paid='0'"), A_OK, True)
out("arts", "EP-ART-06", "CRITICAL", "check-digit", pf("digit=want"), A_OK, True)
out("arts", "EP-ART-07", "ERROR", "barcode-structure", pf("consid=cons", "manual_review"), f"{A_OK} and cons is not null", True)
out("arts", "EP-ART-08", "ERROR", "barcode-structure", pf("list_contains(aids,cand)", "manual_review"), f"{A_OK} and len(aids)>0", True)
out("arts", "EP-SVC-01", "ERROR", "service-code", pf(f"service in {inside(R.SERVICES)}"), A_OK, True)
out("arts", "EP-SVC-02", "ERROR", "service-code", pf(f"product in {inside(R.PRODUCTS)}"), A_OK, True)
FITS = " or ".join(f"(service={q(s)} and product in {inside(ps)})" for s, ps in R.SERVICE_PRODUCTS.items())
out("arts", "EP-SVC-03", "ERROR", "service-code", pf(f"service not in {inside(R.SERVICES)} or {FITS}"), A_OK, True)
ALLOWED = {"base": R.PRODUCTS, "parcel-post": ["00093", "00091"], "express-post": ["00096", "00087"], "returns": ["00065", "00068"]}
out("arts", "EP-SVC-07", "ERROR", "service-code", "case " + " ".join(f"when variant={q(v)} and product in {inside(p)} then 'pass'" for v, p in ALLOWED.items()) + " else 'fail' end", f"{A_OK} and variant<>'sscc'", True)
out("dms", "EP-DM-04", "CRITICAL", "datamatrix", pf("not literal"), idx=True)
out("dms", "EP-DM-05", "CRITICAL", "datamatrix", pf("regexp_matches(coalesce(postcode,''),'^\\d{4}$')"), idx=True)
out("dms", "EP-TO-08", "ERROR", "datamatrix", "case when len(pc4)=0 then 'manual_review' when list_contains(pc4,postcode) then 'pass' else 'fail' end", "coalesce(postcode,'')<>''", True)
out("dms", "EP-DM-06", "ERROR", "datamatrix", pf("regexp_matches(dpid,'^\\d{8}$') and dpid<>'00000000'"), "dpid is not null", True)
out("dms", "EP-DM-06-NA", "INFO", "datamatrix", "'pass'", "dpid is null", True)
STAMP = " and ".join(f"cast(substr(stamp,{o},2) as int) between {a} and {b}" for o, a, b in ((3, 1, 12), (5, 1, 31), (7, 0, 23), (9, 0, 59), (11, 0, 59)))
out("dms", "EP-DM-07", "CRITICAL", "datamatrix", f"case when not regexp_matches(coalesce(stamp,''),'^\\d{{12}}$') then 'fail' when {STAMP} then 'pass' else 'fail' end", idx=True)
out("lab", "EP-LAY-05-PP", "WARNING", "label-layout", "case when ltype is null then 'manual_review' when contains(ltype,'Express') then 'warning' else 'pass' end", "variant='parcel-post'")
out("lab", "EP-LAY-05", "ERROR", "label-layout", "case when contains(coalesce(ltype,''),'Express') then 'pass' else 'manual_review' end", "variant='express-post'")
out("arts", "EP-RET-01", "ERROR", "service-code", pf("service in ('03','08')"), f"{A_OK} and variant='returns'", True)
out("arts", "EP-RET-02", "ERROR", "barcode-structure", pf("acount='01'"), f"{A_OK} and variant='returns'", True)
out("lab", "EP-RET-03", "CRITICAL", "sscc", pf("n_valid=0"), "variant='returns'")
out("lab", "EP-SS-01", "CRITICAL", "sscc", pf("n_valid>0"), "variant='sscc'")
out("lab", "EP-SS-02", "CRITICAL", "sscc", pf("n_invalid=0"), "variant='sscc'")
out("lab", "EP-SS-05", "INFO", "sscc", "'pass'", "variant='sscc'")
LISTS = """, gs1 as (select s.*, row_number() over (partition by label_id order by is_dm, scan_seq)-1 as i, count(*) over (partition by label_id) as n from sc s where filled and (is_dm or not sscc20)),
 dms as (select s.*, l.pc4, row_number() over (partition by label_id order by scan_seq)-1 as i, count(*) over (partition by label_id) as n from sc s join lab l using (label_id) where s.filled and s.is_dm),
 arts as (select a.*, l.variant, l.cons, l.aids, row_number() over (partition by label_id order by s0)-1 as i, count(*) over (partition by label_id) as n from art a join lab l using (label_id)
  where a.atype = case when a.fmt='sscc' then 'sscc' else 'eparcel-standard' end), res as (""" + " union all ".join(RULES) + ")"
EPR = EPL + LISTS
ORACLES["rules_eparcel"] = EPR + " select * from res"

# -- reports on the rule rows ------------------------------------------------------------------------
SUMMARY = """case when bool_or(status='fail' and severity in ('CRITICAL','ERROR')) then 'FAIL' when bool_or(status in ('warning','manual_review')) then 'REVIEW' else 'PASS' end as overall_status,
 count(*) as total, count_if(severity='CRITICAL') as critical, count_if(severity='ERROR') as errors, count_if(severity='WARNING') as warnings,
 count_if(status='manual_review') as manual_review, count_if(status='fail') as failed, count_if(status='pass') as passed"""
ORACLES["summarize_labels"] = EPR + f" select label_id, {SUMMARY} from res group by 1"
PANEL = decode(decode("category", SECTION_OF, "category"), PANELS["eparcel"], "'other'")
ORACLES["section_tones"] = EPR + f""" select label_id, {PANEL} as panel, count(*) as rows, case when bool_or(status='fail') then 'fail' when bool_or(status in ('warning','manual_review')) then 'review'
 when bool_or(status='pass') then 'pass' else 'neutral' end as tone from res group by 1, 2"""
ORACLES["report_filters"] = EPR + " select label_id, count_if(status in ('fail','warning','manual_review')) as issues, count(*) as all_rows, count_if(status='pass') as passes from res group by 1"
ORACLES["service_product_compatible"] = EPD + f""" select label_id, cand as article_id, any_value(service) as service, any_value(product) as product,
 any_value(service not in {inside(R.SERVICES)} or {FITS}) as compatible from dec where m is not null group by 1, 2"""
SNAME = decode("service", {c: v[0] for c, v in R.SERVICES.items()})
SALLOW = decode("service", {c: ", ".join(v) for c, v in R.SERVICE_PRODUCTS.items()})
ORACLES["service_product_rows"] = EPD + f""", a as (select distinct label_id, cand as article_id, service, product, {SNAME} as sn, {decode('product', R.PRODUCTS)} as pn, {SALLOW} as al, ({FITS}) as ok from dec where m is not null)
 select label_id, article_id, 'SERVICE_KNOWN' as id, case when sn is null then 'fail' else 'pass' end as status, coalesce('Service ' || service || ': ' || sn, 'Unknown service code ' || service) as message, '' as expected, service as actual from a
 union all select label_id, article_id, 'PRODUCT_KNOWN', case when pn is null then 'fail' else 'pass' end, coalesce('Product ' || product || ': ' || pn, 'Unknown product code ' || product), '', product from a
 union all select label_id, article_id, 'SERVICE_PRODUCT_MATCH', case when ok then 'pass' else 'fail' end, 'Service ' || service || case when ok then ' supports product ' else ' does not support product ' end || product || '.', al, product from a where sn is not null"""

# -- coded checks --------------------------------------------------------------------------------------
F0 = "select label_id, {id} as id, {sev} as severity, {cat} as category, {st} as status, {msg} as message, {exp} as expected, {act} as actual from lab"


def fixed(id, sev, cat, st, msg, act="''", exp="''"):
    return F0.format(id=q(id), sev=sev, cat=q(cat), st=st, msg=msg, exp=exp, act=act)


def when(cond, yes, no):
    return f"case when {cond} then {yes} else {no} end"


FACT_ROWS = [
    fixed("TEXT_EXTRACTED", when("len(ls)>0", "'INFO'", "'WARNING'"), "label-layout", when("len(ls)>0", "'pass'", "'manual_review'"),
          when("len(ls)>0", "len(ls) || ' text line(s) were extracted from the file.'", "'No selectable or OCR text was extracted from this label.'")),
    fixed("LABEL_TYPE", "'INFO'", "label-layout", when("ltype is not null", "'pass'", "'not_applicable'"),
          when("ltype is not null", "'Detected label header text: ' || ltype || '.'", "'Product branding/header was not exposed in the PDF text layer. Product family is assessed from the decoded product code instead.'"), "coalesce(ltype,'')"),
    fixed("VISIBLE_ARTICLE_ID", "'INFO'", "address-format", when("len(aids)>0", "'pass'", "'warning'"),
          when("len(aids)>0", "'Visible AP Article ID value(s) extracted: ' || array_to_string(aids,', ') || '.'", "'No visible AP Article ID was extracted from text.'"), "array_to_string(aids,', ')"),
    fixed("VISIBLE_CONS_NO", "'INFO'", "address-format", when("cons is not null", "'pass'", "'manual_review'"),
          when("cons is not null", "'Visible consignment number extracted: ' || cons || '.'", "'No visible Cons No value was extracted.'"), "coalesce(cons,'')"),
    fixed("WEIGHT_PRESENT", "'INFO'", "label-layout", when("wt is not null", "'pass'", "'manual_review'"),
          when("wt is not null", "'Weight value found: ' || wt || 'kg.'", "'Weight value was not extracted from the text layer or decoded barcode payload.'"), "coalesce(wt||'kg','')"),
]
ORACLES["label_fact_checks"] = EPL + " " + " union all ".join(FACT_ROWS)
ORACLES["startrack_text_check"] = STT + """ select label_id, 'ST_TEXT_EXTRACTED' as id, case when len(ls)>0 then 'INFO' else 'WARNING' end as severity, 'startrack-label-layout' as category,
 case when len(ls)>0 then 'pass' else 'manual_review' end as status, case when len(ls)>0 then len(ls) || ' text line(s) were extracted from the file.'
 else 'No selectable text was extracted. Barcode evidence is still assessed from the rendered image.' end as message, '' as expected, '' as actual from tx"""

# -- payloads --------------------------------------------------------------------------------------------
KNOWN = [("allow_partial_delivery", "boolean"), ("articles[0].article_id", "string"), ("articles[0].product_id", "string"), ("authority_to_leave", "boolean"),
         ("consignment_id", "string"), ("dangerous_goods", "string"), ("safe_drop_enabled", "boolean"), ("to.lines[0]", "string"), ("to.lines[1]", "string"),
         ("to.postcode", "string"), ("to.state", "string"), ("to.suburb", "string"), ("weight", "number")]
LEAVES = " union all ".join(f"select payload_id, {q(p)} as path, js->>'$.{p}' as value, {q(t)} as value_type from pay where js is not null" for p, t in KNOWN)
ORACLES["flatten_payloads"] = PAY + f" select *, regexp_replace(upper(value),'[^A-Z0-9]+','','g') as normalized_value from ({LEAVES})"
ORACLES["flatten_event_props"] = "select event_id as payload_id, 'k' as path, props->>'$.k' as value from events"
ORACLES["payload_flags"] = PAY + """ select payload_id, js->>'$.authority_to_leave' = 'true' as authority_to_leave, js->>'$.allow_partial_delivery' = 'true' as allow_partial_delivery,
 js->>'$.safe_drop_enabled' = 'true' as safe_drop_enabled, js->>'$.dangerous_goods' = 'yes' as dangerous_goods from pay where js is not null"""
ORACLES["payload_containment"] = PAY + """ select payload_id, contains(norm_text, postcode) as postcode, contains(norm_text, article) as article, contains(norm_text, b.state) as state,
 cast(null as boolean) as nothing from pay join base b on b.k = payload_id where provided"""

KEY = lambda c: f"regexp_replace(upper({c}),'[^A-Z0-9]+','','g')"
# what identifies a label, one row for each distinct value
WANTED = "atype = case when fmt='sscc' then 'sscc' else 'eparcel-standard' end"
EP_IDS = EPL + PAY[len(EP):] + f""", iv as (select label_id, unnest(aids) as v from lab union all select label_id, cons from lab union all select label_id, cand from art where {WANTED}
 union all select label_id, consid from art where {WANTED}), ids as (select distinct label_id, trim(v) as identity from iv where len({KEY('v')}) >= 6),
 named as (select label_id, payload_id, len(lids) + len(dids) > 0 as parsed from lab)"""
ORACLES["identity_gate"] = EP_IDS + f""", g as (select n.label_id, any_value(parsed) as parsed, count(identity) as k, bool_or(contains(norm_text, {KEY('identity')})) as hit
 from named n join pay using (payload_id) left join ids using (label_id) where provided group by 1) select label_id, k > 0 or parsed as gate_applied, hit as identity_matches from g"""
ORACLES["find_payloads"] = EP_IDS + f""", lv as (select distinct payload_id as found_payload_id, {KEY('value')} as key from ({LEAVES}) where len({KEY('value')}) >= 6)
 select distinct label_id, found_payload_id from ids join lv on key = {KEY('identity')}"""

# -- reading order of positioned text: anchors are found by recursion, one after the other
ORACLES["lines_from_items"] = """with recursive it as (select distinct l_orderkey as label_id, cast(l_partkey * 1000 + l_suppkey * 10 + l_linenumber as int) as item_seq, 'W' || l_partkey as t,
 cast(l_partkey % 500 as double) as x, cast((l_suppkey * 13 + l_linenumber) % 90 as double) as y from lineitem),
 ch as (select label_id, max(y) as a from it group by 1 union all select label_id, a from (select it.label_id, max(it.y) as a from ch join it on it.label_id = ch.label_id and ch.a - it.y > 3.5 group by it.label_id, ch.a)),
 an as (select it.*, (select min(a) from ch where ch.label_id = it.label_id and a >= it.y) as a from it),
 pc as (select *, lag(x) over w as px, lag(t) over w as pt from an window w as (partition by label_id, a order by x, -y, item_seq, t)),
 ln as (select label_id, a, trim(regexp_replace(string_agg(case when px is null then '' when x - (px + length(pt) * 5) > 18 then '     ' else ' ' end || t, '' order by x, -y, item_seq, t), '\\s{4,}', '   ', 'g')) as line from pc group by 1, 2)
 select label_id, cast(row_number() over (partition by label_id order by a desc) as int) as line_no, a as y, line from ln where line <> ''"""

# -- matrices ----------------------------------------------------------------------------------------------
MATRIX = ", ".join(f"({q(s)}, {q(p)}, {q(R.WINE_PRODUCT_NAME if s in R.WINE_SERVICES else R.PRODUCTS[p])}, {', '.join(str(x).lower() for x in R.SERVICE_FLAGS[s])})" for s, ps in R.SERVICE_PRODUCTS.items() for p in ps)
ORACLES["service_matrix"] = EPD + f""", mx as (select * from (values {MATRIX}) t(service_code, product_code, product_name, safe_drop, signature, atl, partial, no_signature)),
 a as (select distinct label_id, service, product from dec where m is not null)
 select label_id, service_code, product_code, any_value(product_name) as product_name, any_value(safe_drop) as safe_drop, any_value(signature) as signature, any_value(atl) as atl, any_value(partial) as partial,
 any_value(no_signature) as no_signature, bool_or(product = product_code) as selected_cell from a join mx on service = service_code group by 1, 2, 3"""
ORACLES["unit_permitted"] = STD + f""" select label_id, {QF['unitType']} as unit, {QF['productCode']} as product,
 {' or '.join(f"({QF['unitType']}={q(u)} and ({QF['productCode']} = '' or {QF['productCode']} in {inside(ps)}))" for u, ps in R.UNIT_PRODUCTS.items())} as permitted,
 case when permitted then 'Unit type ' || unit || ' is permitted' || coalesce(' for ' || nullif(product,''),'') || '.'
 else 'Unit type ' || coalesce(nullif(unit,''),'blank') || ' could not be confirmed against product ' || coalesce(nullif(product,''),'unknown') || '.' end as message from dec where kind='qr' and is_qr"""

# -- batch checks and stream ---------------------------------------------------------------------------------
ORACLES["duplicate_consignments"] = """with d as (select l_partkey % 500 as consignment_id, l_suppkey as customer_id, datediff('day', date '1990-01-01', cast(l_shipdate as date)) as day from lineitem),
 g as (select *, day - lag(day) over (partition by consignment_id order by day) as gap from d)
 select consignment_id, count(*) as uses, bool_or(coalesce(gap,730) < 730) as reused_in_2_years, count(distinct customer_id) as customers from g group by 1 having count(*) > 1"""
ORACLES["atl_consistency"] = """with d as (select l_orderkey as connote, case when l_linenumber % 3 <> 0 then 'C' || lpad(cast(l_partkey % 5 as string),9,'0') end as a from lineitem)
 select connote, count(distinct a) as codes, count(a) as labels, min(a) as first_code from d where a is not null group by 1 having count(distinct a) > 1"""
ORACLES["unit_type_limit"] = """with d as (select l_orderkey % 3000 as connote, 'U' || l_partkey % 40 as u, l_suppkey % 50 = 0 as s from lineitem)
 select connote, count(distinct u) as unit_types, count(*) as items, bool_or(s) as single_item, count(distinct u) > 12 as too_many_types, bool_or(s) and count(*) > 1 as not_single from d group by 1
 having count(distinct u) > 12 or (bool_or(s) and count(*) > 1)"""
ORACLES["item_sequence"] = STD + f""", g as (select l_orderkey as connote, l_linenumber as i, count(*) as n, any_value(q) as quantity from lineitem
 join (select label_id, try_cast({QF['consignmentQuantity']} as int) as q from dec where kind='qr' and is_qr) on label_id = l_orderkey group by 1, 2)
 select connote, cast(sum(n) as bigint) as labels, count(*) as distinct_items, max(i) as highest_item, any_value(quantity) as quantity, count_if(n > 1) as repeated_items,
 count(*) = any_value(quantity) and max(i) = any_value(quantity) and count_if(n > 1) = 0 as complete from g group by 1"""
ORACLES["location_check"] = """with c as (select c_custkey, c_nationkey as nk, 'NATION_' || (c_nationkey + case when c_custkey % 10 = 0 then 1 else 0 end) as suburb, case when c_custkey % 4 = 0 then 'SYD' else 'MEL' end as depot from customer)
 select c_custkey, case when n_nationkey is null then 'unknown location' when depot = case when n_regionkey % 2 = 0 then 'SYD' else 'MEL' end then 'match' else 'depot mismatch' end as location_status
 from c left join nation on n_nationkey = nk and n_name = suburb"""


def event_base() -> str:
    sql = "(select event_id as o_orderkey, user_id as o_custkey, ts from events)"
    for layer in corpus.EPARCEL_LAYERS:
        sql = f"(select {', '.join(layer if layer[0] == '*' else [*layer, 'ts'])} from {sql})"
    return sql


ORACLES["stream_audit"] = (
    f"with base as materialized (select * from {event_base()}), scans_t as (select label_id, 0 as scan_seq, linear_raw as raw_value, 'code_128' as format, '' as kind, ts from base)" + DEC
    + """ select date_trunc('day', ts) as window_start, case when atype='sscc' then 'sscc' when digit=want then 'valid' when atype is not null then 'check digit mismatch'
 when reject is not null then 'rejected' else 'no article' end as verdict, count(*) as scans from dec group by 1, 2"""
)

# -- routing and comparison choices ------------------------------------------------------------------------------
ORACLES["route_product_match"] = STD + f""", lin as (select * from dec where raw_value <> '' and (regexp_matches(format,'(?i)128|code') or kind='linear')),
 f as (select label_id, min_by(fproduct, scan_seq) as fp from lin where is_fr group by 1),
 g as (select label_id, min_by({QF['productCode']}, scan_seq) as qp from dec where is_qr and (regexp_matches(format,'(?i)qr') or kind='qr') group by 1),
 r as (select label_id, row_number() over (partition by label_id order by scan_seq) - 1 as i, rlabel from lin where is_rt),
 j as (select r.*, coalesce(fp, qp, '') as product from r left join f using (label_id) left join g using (label_id)),
 w as (select *, {FLABEL('product')} as want from j)
 select label_id, cast(i as integer) as i, product, rlabel as label_code, want is null or want = rlabel as matches from w"""
CASES = lambda table, default: "case " + " ".join(f"when regexp_matches(upper(rule_id), {q(p)}) then {q(n)}" for p, n in table) + f" else {q(default)} end"
# Written out, not imported: the fields and comparisons that rule ids choose.
FIELDS = [
    ("CONSIGNMENT|CONS_NO|CONNOTE|VISIBLE_CONS|ST_CONNOTE|EP-ART-03|EP-ART-07|ST-QR-F03|ST-X-01", "consignment_id"),
    ("ARTICLE|FREIGHT|VISIBLE_ARTICLE|SSCC|AI91|ST_FREIGHT_BARCODE_PRESENT|DATAMATRIX_PRESENT|GS1_128_PRESENT|EP-ART-0[124568]|EP-LIN|EP-SS-|EP-DM-01|ST-FRT|ST-SSC|ST-X-02|ST-QR-F04", "article_id"),
    ("PRODUCT|ST_QR_PRODUCT|ST_PRODUCT_KNOWN|EP-SVC-02|EP-SVC-07|ST-PRD|ST-QR-F05", "product_code"),
    ("SERVICE|SERVICE_PRODUCT_MATCH|EP-SVC-01|EP-SVC-03|EP-RET-01", "service_code"),
    ("ROUTE|ROUTING|ST_ROUTE|ST-RTE-02A|ST-RTE-03", "routing_code"),
    ("POSTCODE|DM_POSTCODE|ST_QR_POSTCODE|EP-DM-05|EP-TO-08|ST-QR-F02|ST-RTE-02B|ST-RTE-04", "delivery_postcode"),
    ("WEIGHT|ST_WEIGHT|ST-QR-F09|ST-ITM-04", "weight"),
    ("CUBE|CUBIC|ST-ITM-05", "cubic_volume"),
    ("DG|DANGEROUS|EP-LAY-07|ST-QR-F19", "dangerous_goods"),
    ("ADDR_TO|RECEIVER|EP-TO-|ST-RCV", "receiver_address"),
    ("ADDR_FROM|SENDER|LODGE|LODGEMENT|EP-FR-|ST-SND", "lodgement_address"),
    ("DATE|8008|EP-DM-07|EP-LAY-06|ST-QR-F11", "label_generation_datetime"),
    ("LABEL_CODE|BRAND|LOGO|HEADER|EP-LAY-05|ST-HDR-0[12]", "label_branding"),
]
KINDS_OF = [
    ("ARTICLE|FREIGHT|VISIBLE_ARTICLE|SSCC|AI91|GS1_PREFIX|DATAMATRIX_PRESENT|GS1_128_PRESENT|ST_FREIGHT_BARCODE_PRESENT|ST_SSCC|EP-ART-0[124568]|EP-LIN|EP-SS-|EP-DM-01|ST-FRT|ST-SSC|ST-X-02|ST-QR-F04", "article"),
    ("CONSIGNMENT|CONS_NO|CONNOTE|VISIBLE_CONS|ST_CONNOTE|EP-ART-03|EP-ART-07|ST-QR-F03|ST-X-01", "consignment"),
    ("PRODUCT|SERVICE_KNOWN|SERVICE_PRODUCT_MATCH|ST_QR_PRODUCT|ST_ROUTE_PRODUCT_MATCH|EP-SVC|EP-RET-01|ST-PRD|ST-QR-F05|ST-RTE-03", "product"),
    ("ROUTE|ROUTING|POSTCODE|DM_POSTCODE|ST_QR_POSTCODE|EP-DM-05|EP-TO-08|ST-QR-F02|ST-RTE", "postcode"),
    ("WEIGHT|ST_WEIGHT|ST-QR-F09|ST-ITM-04", "weight"),
    ("CUBE|CUBIC|ST-ITM-05", "cube"),
    ("DG|DANGEROUS|EP-LAY-07|ST-QR-F19", "dangerous_goods"),
    ("ADDR_TO|RECEIVER|EP-TO-|ST-RCV", "receiver"),
    ("ADDR_FROM|SENDER|LODGE|LODGEMENT|EP-FR-|ST-SND", "sender"),
    ("DATE|8008|EP-DM-07|EP-LAY-06|ST-QR-F11", "date"),
    ("LABEL_CODE|BRAND|LOGO|HEADER|EP-LAY-05|ST-HDR-0[12]", "branding"),
]
ORACLES["comparable_fields"] = EPR + f" select rule_id, {CASES(FIELDS, '')} as field, {CASES(KINDS_OF, 'none')} as comparison, count(*) as n from res group by 1, 2, 3"

# Written out, not imported: code, name, group and label code of the StarTrack products.
FREIGHT = [
    ("TSE", "Tradeshow Express", "Special Services", "TSE"), ("RET", "Express Tail-Lift", "Special Services", "RET"),
    ("RE2", "Express Tail-Lift 2 man", "Special Services", "RE2"), ("APT", "Premium Tail-Lift", "Special Services", "APT"),
    ("PRM", "Premium", "Premium services", "PRM"), ("FPP", "1, 3 & 5Kg Fixed Price Premium", "Premium services", "PRM"),
    ("ARL", "Airlock", "Premium services", "ARL"), ("FPA", "1, 3 & 5Kg Fixed Price Airlock", "Premium services", "ARL"),
    ("EXP", "Express", "Express services", "EXP"),
]
# STD and the text facts of the same labels share their first tables, so the facts are a nested query
SLIN = """, lin as (select * from dec where raw_value <> '' and (regexp_matches(format,'(?i)128|code') or kind='linear')),
 qrs as (select * from dec where raw_value <> '' and is_qr and (regexp_matches(format,'(?i)qr') or kind='qr'))"""
ORACLES["product_matrix"] = STD + SLIN + f""", fp as (select * from (values {', '.join('(' + ', '.join(q(x) for x in row) + ')' for row in FREIGHT)}) t(product_code, product_name, product_group, label_code)),
 codes as (select label_id, fproduct as p, null as l from lin where is_fr union all select label_id, nullif({QF['productCode']},''), null from qrs
  union all select label_id, null, rlabel from lin where is_rt union all
  select label_id, null, coalesce(label_code, rl, {FLABEL('fp1')}, {FLABEL('qp')}, nullif(qp,'')) from ({ORACLES['startrack_facts']})
   left join (select label_id, min_by(rlabel, scan_seq) as rl from lin where is_rt group by 1) using (label_id)
   left join (select label_id, min_by(fproduct, scan_seq) as fp1 from lin where is_fr group by 1) using (label_id)
   left join (select label_id, min_by({QF['productCode']}, scan_seq) as qp from qrs group by 1) using (label_id)),
 hits as (select label_id, fp.*, true as a, false as b from codes join fp on p = product_code union all select label_id, fp.*, false, true from codes join fp on l = label_code)
 select label_id, product_code, any_value(product_name) as product_name, any_value(product_group) as product_group, any_value(label_code) as label_code,
 bool_or(a) as selected_product, bool_or(b) as selected_label_code from hits group by 1, 2"""

# -- StarTrack evidence, modes and variants -------------------------------------------------------------------------
SEV = STD + SLIN + f""", tf as ({ORACLES['startrack_facts']}),
 qa as (select label_id, count(*) as nq, min_by({QF['productCode']}, scan_seq) as qp, string_agg(distinct nullif({QF['receiverPostcode']},''), '|') as pcs,
  list(distinct {QF['atlNumber']}) filter (where {QF['atlNumber']} <> '') as qatl, list(nullif({QF['productCode']},'')) as qps from qrs group by 1),
 la as (select label_id, count_if(is_fr) as nf, count_if(is_rt) as nr, count_if(is_atl) as na, min_by(fproduct, scan_seq) filter (where is_fr) as fp1,
  min_by(rlabel, scan_seq) filter (where is_rt) as rl, list(fproduct) filter (where is_fr) as fps from lin group by 1),
 ca as (select label_id, count_if(raw_value <> '') as scan_count, count_if(raw_value <> '' and s18 is not null and swant = right(s18,1)) as nv from dec group by 1),
 se as (select l.label_id, l.label_format, l.extracted_text, coalesce(nq,0) as nq, coalesce(nf,0) as nf, coalesce(nr,0) as nr, coalesce(na,0) as na, coalesce(nv,0) as nv,
  coalesce(scan_count,0) as scan_count, coalesce(fp1, qp, '') as product, coalesce(pcs,'') as qr_postcodes, atl_text,
  list_concat(list_filter(string_split(coalesce(atl_numbers,''), '|'), lambda x: x <> ''), list_filter(coalesce(qatl,[]), lambda x: not list_contains(string_split(coalesce(atl_numbers,''), '|'), x))) as atls,
  list_concat(coalesce(fps,[]), coalesce(qps,[]), [coalesce(label_code, rl, {FLABEL('fp1')}, {FLABEL('qp')}, nullif(qp,''))]) as codes
  from labels_t l left join tf using (label_id) left join qa using (label_id) left join la using (label_id) left join ca using (label_id))"""
ORACLES["startrack_evidence"] = SEV + """ select label_id, cast(nq as int) as qr, cast(nf as int) as freight, cast(nr as int) as routing, cast(na as int) as atl, cast(nv as int) as sscc_valid, product, qr_postcodes,
 array_to_string(atls,'|') as atl_numbers, atl_text or len(atls) > 0 as atl_expected, label_format='sscc' or (nv > 0 and nf = 0) as sscc_only, cast(scan_count as int) as scan_count from se"""
ORACLES["detect_mode_and_variant"] = f"""select 'eparcel' as carrier, label_id, {EP_MODE} as detected_carrier, {EP_FMT} as detected_format, variant from ({EPL} select * from lab)
 union all select 'startrack', label_id, case when nq+nf+nr+na+nv > 0 or regexp_matches(coalesce(extracted_text,''), '(?i)STAR\\s*TRACK') then 'startrack' else 'unknown' end,
 case when nf > 0 then 'standard' when nv > 0 then 'sscc' else 'unknown' end, case when label_format='sscc' then 'sscc' when list_has_any(codes, ['FPP','FPA']) then 'fpp'
 when list_has_any(codes, ['PRM','APT','ARL']) then 'premium' when list_has_any(codes, ['EXP','TSE','RET','RE2']) then 'express' else 'base' end from ({SEV} select * from se)"""
MODES = f"""select 'eparcel' as carrier, label_id, {EP_MODE} as dc, {EP_FMT} as df, case when label_format='sscc' then 'sscc' else 'standard' end as sf from ({EPL} select * from lab)
 union all select 'startrack', label_id, case when nq+nf+nr+na+nv > 0 or regexp_matches(coalesce(extracted_text,''), '(?i)STAR\\s*TRACK') then 'startrack' else 'unknown' end,
 case when nf > 0 then 'standard' when nv > 0 then 'sscc' else 'unknown' end, case when label_format='sscc' then 'sscc' else 'standard' end from ({SEV} select * from se)"""
CNAME = lambda c: f"case {c} when 'startrack' then 'StarTrack' when 'eparcel' then 'eParcel' else 'unknown' end"
FNAME_OF = lambda c: f"case {c} when 'sscc' then 'SSCC article identifier' when 'standard' then 'Standard article format' end"
ORACLES["audit_mode_checks"] = f"""with m as ({MODES})
 select carrier, label_id, 'AUDIT_MODE_CARRIER' as id, 'CRITICAL' as severity, 'audit-mode' as category, case when dc = carrier then 'pass' else 'fail' end as status,
 {CNAME('carrier')} || case when dc = carrier then ' was selected and label evidence matches.' else ' was selected, but decoded/text evidence indicates ' || {CNAME('dc')} || '.' end as message,
 {CNAME('carrier')} as expected, {CNAME('dc')} as actual from m
 union all select carrier, label_id, 'AUDIT_MODE_FORMAT', 'CRITICAL', 'audit-mode', case when df = sf then 'pass' else 'fail' end,
 {FNAME_OF('sf')} || case when df = sf then ' was selected and decoded barcode evidence matches.' else ' was selected, but decoded barcode evidence indicates ' || coalesce({FNAME_OF('df')}, 'unknown format') || '.' end,
 {FNAME_OF('sf')}, coalesce({FNAME_OF('df')}, 'unknown') from m"""

ORACLES["label_identities"] = f"""select 'eparcel' as carrier, label_id, identity from ({EP_IDS} select * from ids) union all
 select 'startrack', label_id, identity from ({SEV}, iv as (select label_id, unnest([article_ids, connote]) as v from tf union all select label_id, unnest([bare, left(bare,12)]) from lin where is_fr
 union all select label_id, unnest([{QF['freightItemNumber']}, {QF['connoteNumber']}]) from qrs union all select label_id, unnest(['00' || s18, s18]) from dec where raw_value <> '' and swant = right(s18,1))
 select distinct label_id, trim(v) as identity from iv where len({KEY('v')}) >= 6)"""

# -- SSCC options and rows, summaries of the whole audit -------------------------------------------------------------


def sscc_rows(carrier: str, gate: str = "true") -> str:
    """Rows of the SSCC option checks over lx (a label's expectation, vids, vext, vser, vs18, ireason, iraw)."""
    prefix, cat = ("SSCC_EXPECTED", "sscc") if carrier == "eparcel" else ("ST_SSCC_EXPECTED", "startrack-sscc")
    use = f"{gate} and provided and reason = ''"
    kept = lambda test: f"array_to_string(list_filter(list_transform(range(1, len(vids) + 1), lambda k: case when {test} then vids[k] end), lambda v: v is not null), ', ')"
    ext, co = kept("vext[k] = extensionDigit"), kept("starts_with(vser[k], companyPrefix) or starts_with(vs18[k], companyPrefix)")
    head = lambda ident, sev: f"select label_id, '{prefix}_{ident}' as id, '{sev}' as severity, '{cat}' as category, "
    return " union all ".join([
        head("PREFIX_INPUT", "ERROR") + f"'fail' as status, reason as message, '' as expected, coalesce(raw,'') as actual from lx where {gate} and provided and reason <> ''",
        head("DECODED", "CRITICAL") + f"""case when len(vids) > 0 then 'pass' else 'fail' end, case when len(vids) > 0 then len(vids) || ' valid AI 00 SSCC barcode(s) decoded.'
 else coalesce(ireason, 'SSCC assessment was selected, but no valid AI 00 SSCC barcode was decoded.') end,
 case when len(vids) > 0 then '' when companyPrefix <> '' then 'AI 00 SSCC with GS1 Company Prefix ' || companyPrefix else 'AI 00 SSCC' end,
 case when len(vids) > 0 then array_to_string(vids, ', ') else coalesce(nullif(iraw,''), 'not decoded') end from lx where {use}""",
        head("EXTENSION_DIGIT", "ERROR") + f"""case when {ext} <> '' then 'pass' else 'fail' end, case when {ext} <> '' then 'Decoded SSCC extension digit matches ' || extensionDigit || '.'
 else 'No decoded SSCC uses extension digit ' || extensionDigit || '.' end, extensionDigit, case when {ext} <> '' then {ext} else array_to_string(vext, ', ') end
 from lx where {use} and len(vids) > 0 and extensionDigit <> ''""",
        head("COMPANY_PREFIX", "ERROR") + f"""case when {co} <> '' then 'pass' else 'fail' end, case when {co} <> '' then 'Decoded SSCC company prefix matches ' || companyPrefix || '.'
 else 'No decoded SSCC starts with GS1 Company Prefix ' || companyPrefix || '.' end, companyPrefix, case when {co} <> '' then {co} else array_to_string(vs18, ', ') end
 from lx where {use} and len(vids) > 0 and companyPrefix <> ''""",
    ])


SGOOD, SBAD = "raw_value <> '' and s18 is not null and swant = right(s18,1)", "raw_value <> '' and s18 is not null and swant <> right(s18,1)"
SREASON = "'SSCC check digit mismatch. Expected ' || swant || ', got ' || right(s18,1) || '.'"
SLISTS = XS + f""", lists as (select label_id, list('00' || s18 order by scan_seq) filter ({SGOOD}) as vids, list(left(s18,1) order by scan_seq) filter ({SGOOD}) as vext,
 list(substr(s18,2,16) order by scan_seq) filter ({SGOOD}) as vser, list(s18 order by scan_seq) filter ({SGOOD}) as vs18, min_by({SREASON}, scan_seq) filter ({SBAD}) as ireason,
 string_agg(raw_value, ', ' order by scan_seq) filter ({SBAD}) as iraw from dec group by 1),
 lx as (select label_id, label_format, {XCOLS}, coalesce(vids,[]) as vids, coalesce(vext,[]) as vext, coalesce(vser,[]) as vser, coalesce(vs18,[]) as vs18, ireason, iraw from xs left join lists using (label_id))"""
EP_SSCC = EPD + SLISTS + """, au as (select label_id, cand, min(scan_seq) as s0 from dec where raw_value <> '' and atype = 'sscc' group by 1, 2) """ + sscc_rows("eparcel") + """
 union all select label_id, 'SSCC_' || (row_number() over (partition by label_id order by s0) - 1), 'INFO', 'sscc', 'pass',
 'SSCC detected: ' || cand || '. Embedded product/service/check-digit validation does not apply.', '', cand from au join labels_t using (label_id) where label_format = 'sscc'"""
ST_SSCC = SEV + SLISTS.replace("lx as (select label_id,", "lx as (select label_id, se.label_format='sscc' or (nv > 0 and nf = 0) as sonly,").replace(
    "label_format, label_format=", "xs.label_format, xs.label_format=").replace("from xs left join", "from xs join se using (label_id) left join") + " " + sscc_rows("startrack", "sonly") + f"""
 union all select label_id, 'ST_SSCC_' || (row_number() over (partition by label_id order by scan_seq) - 1), 'INFO', 'startrack-sscc', 'pass', 'Valid AI 00 SSCC detected: 00' || s18 || '.', '', '00' || s18
 from dec join lx using (label_id) where sonly and {SGOOD}
 union all select label_id, 'ST_SSCC_INVALID_' || (row_number() over (partition by label_id order by scan_seq) - 1), 'CRITICAL', 'startrack-sscc', 'fail', {SREASON}, swant, right(s18,1) from dec join lx using (label_id) where sonly and {SBAD}
 union all select label_id, 'ST_SSCC_PRODUCT_RULE', 'INFO', 'startrack-sscc', 'pass',
 'SSCC freight labels encode AI 00 SSCC data. StarTrack product may be supplied by QR/routing data, but it is not embedded in the SSCC article identifier.', '', '' from lx where sonly and label_format <> 'sscc'"""
ORACLES["sscc_checks"] = f"select *, 'eparcel' as carrier from ({EP_SSCC}) union all select *, 'startrack' from ({ST_SSCC})"
ALL_ROWS = f"""with au as (select label_id, severity, status from ({ORACLES['rules_eparcel']}) union all select label_id, severity, status from ({ORACLES['label_fact_checks']})
 union all select label_id, severity, status from ({ORACLES['audit_mode_checks']}) where carrier = 'eparcel' union all select label_id, severity, status from ({EP_SSCC})),
 su as (select label_id, {SUMMARY} from au group by 1), fl as (select l.label_id, batch_id, scan_count from ({ORACLES['eparcel_evidence']}) join ({EP} select * from labels_t) l using (label_id))"""
ORACLES["audit_flagship"] = ALL_ROWS + " select * from su join fl using (label_id)"
ORACLES["summarize_batch"] = ALL_ROWS + """ select batch_id, case when bool_or(overall_status='FAIL') then 'FAIL' when bool_or(overall_status='REVIEW') then 'REVIEW' else 'PASS' end as overall_status,
 count(*) as label_count, cast(sum(scan_count) as bigint) as decoded, cast(sum(total) as bigint) as total, cast(sum(passed) as bigint) as passed, cast(sum(failed) as bigint) as failed,
 cast(sum(manual_review) as bigint) as manual_review from su join fl using (label_id) group by 1"""

# -- payload text: matrices and word coverage ---------------------------------------------------------------------------
PAY_TAIL = PAY[len(EP):]
CLOSED = "gate_applied and not coalesce(identity_matches, true)"
SERVICE_SAYS = lambda svc, flag: decode(svc, {c: str(v[("authority_to_leave", "allow_partial_delivery", "safe_drop_enabled").index(flag) + 2]).lower() for c, v in R.SERVICES.items()})
FLAG_TEXT = lambda flag: f"case when contains(ut, '{flag.upper()}') then contains(ut, upper({SERVICE_SAYS('service_code', flag)})) else true end"
ORACLES["service_matrix_payload"] = f"""with m as ({ORACLES['service_matrix']}), g as ({ORACLES['identity_gate']}),
 pl as ({EP}{PAY_TAIL} select label_id, upper(raw_text) as ut from labels_t join pay using (payload_id))
 select label_id, service_code, product_code, case when ({CLOSED}) or not selected_cell then 'N/A' when contains(ut, service_code) and contains(ut, product_code)
 and {FLAG_TEXT('authority_to_leave')} and {FLAG_TEXT('allow_partial_delivery')} and {FLAG_TEXT('safe_drop_enabled')} then 'Match' else 'Does not match' end as payload_match
 from m join g using (label_id) join pl using (label_id)"""
ST_GATE = f"""{ST}{PAY_TAIL}, ids as (select label_id, identity from ({ORACLES['label_identities']}) where carrier = 'startrack')
 select label_id, count(identity) > 0 as gate_applied, bool_or(contains(norm_text, {KEY('identity')})) as identity_matches, any_value(upper(raw_text)) as ut
 from labels_t join pay using (payload_id) left join ids using (label_id) where provided group by 1"""
ORACLES["product_matrix_payload"] = f"""with m as ({ORACLES['product_matrix']}), g as ({ST_GATE})
 select label_id, product_code, case when {CLOSED} then 'N/A' when contains(ut, product_code) or contains(ut, label_code) then 'Match' else 'Does not match' end as payload_match from m join g using (label_id)"""
WORDS = lambda v: expand(f"list_filter(ordered_distinct(flatten(list_transform({v}, lambda x: regexp_extract_all(upper(x), '([A-Z0-9]{{3,}})', 1)))), lambda x: x not in {inside(STOP_WORDS)} and not regexp_matches(x, '^0+$'))")


def covered(carrier: str, side: str, source: str) -> str:
    """source: label_id, norm_text, vals."""
    return f"""select '{carrier}' as carrier, '{side}' as side, label_id, case when len(ts) > 0 then len(ms) >= 3 and (len(cs) = 0 or list_has_any(cs, ms)) end as ok,
 case when len(ts) > 0 then cast(len(ts) as int) end as tokens, case when len(ts) > 0 then array_to_string(ms, '|') end as matches
 from (select *, list_filter(ts, lambda t: contains(norm_text, t)) as ms, list_filter(ts, lambda t: regexp_matches(t, '^\\d{{4}}$')) as cs from (select label_id, norm_text, {WORDS('vals')} as ts from ({source})))"""


EP_BLOCKS = lambda vals: f"{EPT}{PAY_TAIL} select label_id, norm_text, {vals} as vals from tx join pay using (payload_id) where provided"
SPACED = f"trim({QF['receiverSuburb']} || ' ' || {QF['receiverPostcode']})"
QLIST = expand(f"ordered_distinct(list_filter([{QF['receiverName1']}, {QF['receiverName2']}, {QF['receiverAddress1']}, {QF['receiverAddress2']}, {SPACED}], lambda x: x <> ''))")
ST_BLOCKS = lambda vals: (
    f"{STD}{SLIN}{TXT}{PAY_TAIL}, q1 as (select label_id, min_by({QLIST}, scan_seq) as recv, min_by(case when {QF['receiverPostcode']} <> '' then [{SPACED}] else [] end, scan_seq) as pl from qrs group by 1)"
    f" select label_id, norm_text, {vals} as vals from tx join pay using (payload_id) left join q1 using (label_id) where provided")
ORACLES["token_coverage"] = " union all ".join([
    covered("eparcel", "receiver", EP_BLOCKS("list_concat(to_b, plines)")), covered("eparcel", "sender", EP_BLOCKS("from_b")),
    covered("startrack", "receiver", ST_BLOCKS("list_concat(case when len(to_b) > 0 then to_b else coalesce(recv,[]) end, case when len(plines) > 0 then plines else coalesce(pl,[]) end)")),
    covered("startrack", "sender", ST_BLOCKS("from_b")),
])

# -- result rows against payloads -----------------------------------------------------------------------------------------
CHAIN = lambda table, default: "case " + " ".join(f"when regexp_matches(id, '(?i){p}') then '{n}'" for p, n in table) + f" else '{default}' end"
ANY = lambda vals: (
    f"case when len(list_filter({vals}, lambda v: trim(coalesce(v,'')) <> '')) > 0 then len(list_filter({vals}, lambda v: len({KEY('v')}) >= 2 and contains(norm_text, {KEY('v')}))) > 0 end")
AGREES = {n: f"(cast({n} as varchar) = {SERVICE_SAYS('svc', n)})" for n in ("authority_to_leave", "allow_partial_delivery", "safe_drop_enabled")}
COVER = lambda side: f"select label_id, ok as {side} from ({ORACLES['token_coverage']}) where carrier = 'eparcel' and side = '{side}'"
ORACLES["compare_results"] = f"""with r as (select label_id, id, {CHAIN(COMPARISONS, 'none')} as kind, {CHAIN(FIELD_PATTERNS, '')} as field, regexp_matches(id, '{IDENTITY_RULES}') as own from ({ORACLES['rules_eparcel']})),
 pf as ({ORACLES['payload_flags']}), g as ({ORACLES['identity_gate']}), rc as ({COVER('receiver')}), sn as ({COVER('sender')}),
 lv as ({EPL}{PAY_TAIL}, a2 as (select label_id, list(cand) as cands, list(consid) filter (atype <> 'sscc') as cids, list(product) filter (atype <> 'sscc') as prods, list(service) filter (atype <> 'sscc') as svcs,
   min_by(service, s0) filter (atype <> 'sscc') as svc from art where {WANTED} group by 1),
  d2 as (select label_id, list(postcode) as dpc, list(stamp) as stamps from dec where raw_value <> '' and is_dm group by 1)
  select label_id, payload_id, norm_text, svc, dg, mmdd, list_concat(coalesce(cands,[]), aids) as article, list_concat([cons], coalesce(cids,[])) as consignment, list_concat(coalesce(prods,[]), coalesce(svcs,[])) as product,
   list_concat(flatten(list_transform(plines, lambda x: regexp_extract_all(x, '\\b(\\d{{4}})\\b', 1))), coalesce(dpc,[])) as postcode, coalesce(stamps,[]) as stamps, ltype,
   case when wt is not null then [trim(wt), regexp_replace(trim(wt),'\\.0+$',''), regexp_replace(trim(wt),'\\.0+$','') || 'KG', trim(wt) || 'KG'] else [] end as weight
  from lab join pay using (payload_id) left join a2 using (label_id) left join d2 using (label_id) where provided),
 o as (select label_id, norm_text, stamps, mmdd, {CLOSED} as closed, {ANY('article')} as article, {ANY('consignment')} as consignment, {ANY('product')} as anyp, {ANY('postcode')} as postcode, {ANY('weight')} as weight,
  {ANY("[ltype, 'Australia Post']")} as branding, dg = dangerous_goods as dangerous_goods, receiver, sender,
  case when svc in {inside(R.SERVICES)} and coalesce({', '.join(AGREES.values())}) is not null then {' and '.join(f'coalesce({c}, true)' for c in AGREES.values())} end as flags
  from lv join g using (label_id) left join pf using (payload_id) left join rc using (label_id) left join sn using (label_id)),
 j as (select r.*, o.label_id is not null as compared, closed, case kind when 'article' then article when 'consignment' then consignment when 'product' then case when flags is null then anyp else coalesce(anyp,false) and flags end
  when 'postcode' then postcode when 'weight' then weight when 'dangerous_goods' then dangerous_goods when 'receiver' then receiver when 'sender' then sender when 'branding' then branding
  when 'date' then {ANY("list_concat(case when id = 'EP-LAY-06' then [case when mmdd is null then '0 entries' else '1 entries' end] else [] end, stamps)")} end as m from r left join o using (label_id))
 select label_id, id, case when compared then case when closed and not own then 'na' when m then 'match' when not m then 'mismatch' else 'na' end end as payload_status, field as payload_field from j"""

# -- saved evidence and stored tables ---------------------------------------------------------------------------------------
FRESH = "trim(sscc_company_prefix) as p, trim(sscc_extension_digit) as e"
ORACLES["reaudit"] = f"""select label_id, id, severity, status from ({ORACLES['rules_eparcel']}) union all select label_id, id, severity, status from ({ORACLES['label_fact_checks']})
 union all select label_id, id, severity, status from ({ORACLES['audit_mode_checks']}) where carrier = 'eparcel'
 union all select label_id, id, severity, status from ({EP_SSCC.replace(FRESH, "'9315345' as p, '3' as e")})"""
ORACLES["reaudit_payloads"] = ORACLES["compare_results"]
ORACLES["stored_audit"] = ALL_ROWS + " select * from su"

# -- headlines -----------------------------------------------------------------------------------------------------------------
PNAMED = PNAME.replace("case product", "case when product is null then null else case product", 1) + " end"
LOOKED = lambda c: decode(c, {k: v[0] for k, v in R.FREIGHT_PRODUCTS.items()})
ORACLES["label_header"] = f"""select 'eparcel' as carrier, label_id, coalesce(cand, aids[1], 'Label ' || label_id) as article_number,
 case when sonly then 'SSCC label' when contains(lower(coalesce(pname,'')), 'express') then 'Express Post' when contains(lower(coalesce(pname,'')), 'parcel') then 'Parcel Post' else coalesce(pname, 'Product not parsed') end as product,
 case when sonly then '' else coalesce(product,'') end as product_code, case when sonly then 'SSCC label — product code not encoded' else coalesce(pname,'') end as product_name,
 case when sonly then 'Not applicable' else coalesce(service,'') end as service_code,
 case when sonly then 'SSCC barcode does not encode eParcel service code' else coalesce({SNAME}, case when service is not null then {q(R.UNKNOWN_SERVICE)} end, '') end as service_name, sonly as sscc_only
 from ({EPL}, a1 as (select label_id, min_by(cand, s0) as cand, min_by(product, s0) as product, min_by(service, s0) as service from art where {WANTED} group by 1)
  select lab.label_id, aids, label_format = 'sscc' as sonly, cand, product, service, {PNAMED} as pname from lab left join a1 using (label_id))
 union all select 'startrack', label_id, coalesce(fid, '00' || s1, nullif(qid,''), nullif(art,''), 'Label ' || label_id),
 case when s1 is not null and p is null then 'StarTrack SSCC label' else coalesce(name, 'StarTrack product not parsed') end, coalesce(p,''), coalesce(name,''),
 coalesce(rl, {FLABEL('p')}, label_code, rl, {FLABEL('fp')}, {FLABEL('qp')}, nullif(qp,''), 'not parsed'), coalesce(rform, 'Label code ' || {FLABEL('p')}, ''), sonly
 from (select *, coalesce({LOOKED('p')}, case when fid is not null then {q(R.UNKNOWN_FREIGHT_PRODUCT)} end, case when qid is not null then {q(R.UNKNOWN_FREIGHT_PRODUCT)} end) as name from (
  {SEV}, h as (select label_id, min_by(bare, scan_seq) filter (is_fr) as fid, min_by(fproduct, scan_seq) filter (is_fr) as fp, min_by(rlabel, scan_seq) filter (is_rt) as r1,
   min_by(case when g_label is not null then 'GS1 421 routing barcode for AU Domestic SSCC labels' else 'StarTrack routing barcode SSS9999DD/DDD' end, scan_seq) filter (is_rt) as rform from lin group by 1),
  qh as (select label_id, min_by({QF['freightItemNumber']}, scan_seq) as qid, min_by({QF['productCode']}, scan_seq) as qp from qrs group by 1),
  sh as (select label_id, min_by(s18, scan_seq) as s1 from dec where {SGOOD} group by 1)
  select se.label_id, label_format='sscc' or (nv > 0 and nf = 0) as sonly, fid, fp, r1 as rl, rform, qid, qp, s1, article_ids as art, tf.label_code, nullif(coalesce(fp, qp),'') as p
  from se left join h using (label_id) left join qh using (label_id) left join sh using (label_id) left join tf using (label_id)))"""


# -- StarTrack facts completed from decoded symbols ------------------------------------------------------------------------
NUMERIC = lambda v: f"nullif(regexp_replace(coalesce({v},''),'[^0-9.]','','g'),'')"
AS_DOUBLE = lambda v: f"case when {NUMERIC(v)} is not null then coalesce(regexp_replace(cast(try_cast({NUMERIC(v)} as double) as varchar),'\\.0$',''), 'NaN') end"
THOUSANDTHS = lambda v: f"cast(try_cast({NUMERIC(v)} as bigint) / 1000.0 as decimal(30,3))"
AS_CUBE = lambda v: (
    f"case when regexp_matches({NUMERIC(v)},'^\\d+$') then case when {THOUSANDTHS(v)} > 0 then regexp_replace(regexp_replace(cast({THOUSANDTHS(v)} as varchar),'0+$',''),'\\.$','') end else {AS_DOUBLE(v)} end")
KEPT = lambda vals: expand(f"ordered_distinct(list_filter(list_transform({vals}, lambda x: trim(coalesce(x,''))), lambda x: x <> ''))")
QCOLS = ", ".join(f"{e} as {n}" for n, e in QF.items())
PLACE = lambda by: f"row_number() over (partition by label_id order by scan_seq) - 1 as i, count(*) over (partition by label_id) as n from {by}"
SENR = SEV + TXT + f""", qi as (select label_id, {QCOLS}, {PLACE('qrs')}), q1 as (select * from qi where i = 0),
 fi as (select label_id, bare, fproduct, bar_count, {PLACE('lin where is_fr')}),
 ri as (select label_id, raw_value, rlabel, g_label, case when g_label is not null then g_code else p_code end as postcode, case when g_label is not null then '' else p_depot end as depot, {PLACE('lin where is_rt')}),
 ai as (select label_id, bare, {PLACE('lin where is_atl')}),
 vs as (select label_id, list('00' || s18 order by scan_seq) filter ({SGOOD}) as vids, count_if({SBAD}) as ninv from dec group by 1),
 fl as (select label_id, list(left(bare,12)) as fcons, list(bare) as fids from fi group by 1),
 en as (select se.*, tx.j, tx.ls, tx.from_b, coalesce(ninv,0) as ninv, coalesce(fcons,[]) as fcons, coalesce(fids,[]) as fids,
  coalesce(label_code, r1.rlabel, {FLABEL('f1.fproduct')}, {FLABEL('q1.productCode')}, nullif(q1.productCode,'')) as lcode,
  connote, {KEPT("[connote, connote, left(f1.bare,12), connoteNumber]")} as cids,
  {KEPT("list_concat([article_ids, f1.bare, freightItemNumber], coalesce(vids,[]))")} as arts,
  coalesce(weight, {AS_DOUBLE('consignmentWeight')}) as wt, coalesce(cube, {AS_CUBE('consignmentCube')}) as cube, coalesce(unit, nullif(unitType,'')) as unit,
  case when len(to_b) > 0 then to_b else {KEPT("[receiverName1, receiverName2, receiverAddress1, receiverAddress2, trim(receiverSuburb || ' ' || receiverPostcode)]")} end as to_b,
  case when len(plines) > 0 then plines when receiverPostcode <> '' then [trim(receiverSuburb || ' ' || receiverPostcode)] else [] end as plines,
  case when se.label_format='sscc' then 'sscc' when list_has_any(codes, ['FPP','FPA']) then 'fpp' when list_has_any(codes, ['PRM','APT','ARL']) then 'premium'
   when list_has_any(codes, ['EXP','TSE','RET','RE2']) then 'express' else 'base' end as variant
  from se join tx using (label_id) join tf using (label_id) left join q1 using (label_id) left join (select * from fi where i = 0) f1 using (label_id)
   left join (select * from ri where i = 0) r1 using (label_id) left join vs using (label_id) left join fl using (label_id))"""
ORACLES["enriched_facts"] = SENR + f""" select label_id, lcode as label_code, coalesce(connote, cids[1]) as connote, {J('arts')} as article_ids, {J('cids')} as consignment_ids, wt as weight, cube, unit,
 {J('to_b')} as to_block, {J('plines')} as postcode_lines, nq + nf + nr + nv > 0 as decoded_used from en"""

# -- StarTrack rules: one CASE per rule --------------------------------------------------------------------------------------
ST_RULES: list[str] = []
PRODUCT_CODES = inside([f[0] for f in FREIGHT])
HEADER_CODES = inside(["TSE", "RET", "RE2", "APT", "PRM", "ARL", "EXP"])
ITEM, CONNOTE = r"^[A-Z0-9]{4}\d{8}[A-Z0-9]{3}\d{5}$", r"^[A-Z0-9]{4}\d{8}$"
NOT_SSCC, BACK = "variant <> 'sscc'", "movementTypeIndicator in ('C','T')"
SROW = {"l": "en", "q": "qi join en using (label_id)", "f": "fi join en using (label_id)", "r": "ri join en using (label_id)", "a": "ai join en using (label_id)"}


def st(src, rid, sev, cat, status, where="true"):
    ident = f"'{rid}'" if src == "l" else f"'{rid}' || case when n > 1 then '_' || i else '' end"
    ST_RULES.append(f"select label_id, {ident} as id, '{rid}' as rule_id, '{sev}' as severity, 'startrack-{cat}' as category, {status} as status from {SROW[src]} where {where}")


def must(value, cond, fail="fail", gone=None):
    return f"case when coalesce(trim({value}),'') = '' then '{gone or fail}' when {cond} then 'pass' else '{fail}' end"


def shaped(value, pattern, fail="fail", gone=None):
    return must(value, f"regexp_matches({value},'{pattern}')", fail, gone)


ST_SIZE = " or ".join(f"(abs(width_mm-{a})<=8 and abs(height_mm-{b})<=8)" for a, b in ((100, 150), (150, 100), (100, 200), (200, 100)))
SROW["p"] = "(select en.*, width_mm, height_mm, {0} as raster, {1} as dpi from en join labels_t using (label_id))".format(PAGE, DPI)
ST_RULES.append(f"select label_id, 'ST-LAY-01' as id, 'ST-LAY-01' as rule_id, 'WARNING' as severity, 'startrack-label-layout' as category, case when coalesce(width_mm,0)=0 or coalesce(height_mm,0)=0 then 'manual_review' when {ST_SIZE} then 'pass' else 'warning' end as status from {SROW['p']}")
ST_RULES.append(f"select label_id, 'ST-IMG-01', 'ST-IMG-01', 'WARNING', 'startrack-label-layout', {pf('dpi between 200 and 100000', 'warning')} from {SROW['p']} where raster")
st("l", "ST-HDR-01", "WARNING", "text", pf(r"len(list_filter(ls, lambda x: regexp_matches(x,'(?i)STAR\s*TRACK'))) > 0", "manual_review"))
st("l", "ST-HDR-02", "WARNING", "text", must("lcode", f"lcode in {HEADER_CODES}", "manual_review"))
st("l", "ST-HDR-04", "WARNING", "text", pf("len(cids) > 0", "manual_review"))
st("q", "ST-HDR-06", "ERROR", "text", pf(r"regexp_matches(j,'(?i)\*\s*(RETURN|TRANSFER)\s*\*')", "manual_review"), BACK)
st("l", "ST-RCV-01", "ERROR", "text", pf("len(to_b) + len(plines) > 0", "manual_review"))
st("l", "ST-SND-01", "WARNING", "text", pf("len(from_b) > 0", "manual_review"))
st("l", "ST-ITM-04", "WARNING", "text", pf("coalesce(trim(wt),'') <> ''", "manual_review"))
st("l", "ST-ITM-05", "WARNING", "text", pf("coalesce(trim(cube),'') <> ''", "manual_review"))
st("l", "ST-QR-01", "CRITICAL", "qr", pf("nq > 0"))
st("q", "ST-QR-03", "ERROR", "qr", pf(" and ".join(f"{c} <> ''" for c in (
    "receiverSuburb", "receiverPostcode", "connoteNumber", "freightItemNumber", "productCode", "consignmentQuantity", "consignmentWeight", "despatchDate", "receiverName1",
    "unitType", "destinationDepot", "receiverAddress1", "dangerousGoodsIndicator", "movementTypeIndicator"))))
st("q", "ST-QR-F02", "ERROR", "qr", shaped("receiverPostcode", r"^\d{4}$"))
st("q", "ST-QR-F03", "ERROR", "qr", shaped("connoteNumber", CONNOTE))
st("q", "ST-QR-F04", "ERROR", "qr", shaped("freightItemNumber", ITEM), NOT_SSCC)
st("q", "ST-QR-F05", "ERROR", "qr", must("productCode", f"productCode in {PRODUCT_CODES}"))
st("q", "ST-QR-F09", "ERROR", "qr", shaped("consignmentWeight", r"^\d+(\.\d+)?$"))
st("q", "ST-QR-F11", "ERROR", "qr", must("despatchDate", r"regexp_matches(despatchDate,'^\d{8}$') and coalesce(try_cast(substr(despatchDate,5,2) as int) between 1 and 12 and try_cast(substr(despatchDate,7,2) as int) between 1 and 31, false)"))
st("q", "ST-QR-F14", "ERROR", "qr", pf(" or ".join(f"(unitType={q(u)} and (productCode = '' or productCode in {inside(ps)}))" for u, ps in R.UNIT_PRODUCTS.items()), "manual_review"))
st("q", "ST-QR-F19", "ERROR", "qr", must("dangerousGoodsIndicator", "dangerousGoodsIndicator in ('Y','N')"))
st("q", "ST-QR-F20", "ERROR", "qr", must("movementTypeIndicator", "movementTypeIndicator in ('N','C','T')"))
DIGITS_OF = lambda v: f"coalesce(try_cast(regexp_replace({v},'\\D','','g') as hugeint), 0)"
st("q", "ST-QR-F21", "ERROR", "qr", pf(f"{DIGITS_OF('notBeforeDate')} <= {DIGITS_OF('notAfterDate')}"), "notBeforeDate <> '' and notAfterDate <> ''")
st("q", "ST-QR-F23", "ERROR", "qr", pf(r"regexp_matches(atlNumber,'^C\d{9}$')"), "atlNumber <> ''")
st("q", "ST-QR-F24", "ERROR", "qr", pf("raNumber <> ''"), BACK)
st("l", "ST-FRT-01", "CRITICAL", "freight", pf("nf > 0"), NOT_SSCC)
st("f", "ST-FRT-02A", "ERROR", "freight", pf("regexp_matches(left(bare,4),'^[A-Z0-9]{4}$')"), NOT_SSCC)
st("f", "ST-FRT-02B", "ERROR", "freight", pf(r"regexp_matches(substr(bare,5,8),'^\d{8}$')"), NOT_SSCC)
st("f", "ST-FRT-02C", "ERROR", "freight", pf(r"regexp_matches(substr(bare,16,5),'^\d{5}$')"), NOT_SSCC)
st("f", "ST-FRT-03", "ERROR", "freight", pf(f"fproduct in {PRODUCT_CODES}"), NOT_SSCC)
st("f", "ST-PRD-01", "ERROR", "product", pf(f"case variant when 'express' then fproduct in ('EXP','TSE','RET','RE2') when 'premium' then fproduct in ('PRM','APT','ARL') when 'fpp' then fproduct in ('FPP','FPA') else fproduct in {PRODUCT_CODES} end"), NOT_SSCC)
st("f", "ST-FRT-04", "ERROR", "freight", pf(f"regexp_matches(bare,'{ITEM}')"), NOT_SSCC)
st("f", "ST-FRT-08", "ERROR", "freight", pf("list_contains(list_transform(cids, lambda x: upper(replace(x,' ',''))), left(bare,12))", "manual_review"), f"{NOT_SSCC} and len(cids) > 0")
st("f", "ST-FRT-09", "WARNING", "freight", pf("coalesce(bar_count,0) = 61", "warning"), NOT_SSCC)
st("l", "ST-RTE-01", "CRITICAL", "routing", pf("nr > 0"))
st("r", "ST-RTE-02A", "ERROR", "routing", must("rlabel", f"rlabel in {HEADER_CODES}"))
st("r", "ST-RTE-02B", "ERROR", "routing", shaped("postcode", r"^\d{4}$"))
st("r", "ST-RTE-03", "ERROR", "routing", pf(f"coalesce(rlabel = {FLABEL('product')}, {FLABEL('product')} is null)"))
st("r", "ST-RTE-04", "ERROR", "routing", must("postcode", "list_contains(string_split(qr_postcodes,'|'), postcode)"), "qr_postcodes <> ''")
st("r", "ST-RTE-09", "ERROR", "routing", pf(r"regexp_matches(upper(replace(raw_value,' ','')),'^[A-Z0-9]{3}\d{4}[A-Z0-9]{2,3}$')"), "g_label is null")
st("a", "ST-ATL-01", "ERROR", "atl", pf("cast(substr(bare,2) as bigint) between 1 and 999999999"))
st("l", "ST-ATL-02", "WARNING", "atl", pf("na > 0", "manual_review"), "atl_text or len(atls) > 0")
st("a", "ST-ATL-05", "ERROR", "atl", pf("list_contains(atls, bare)", "manual_review"), "len(atls) > 0")
st("a", "ST-ATL-06", "ERROR", "atl", pf(r"regexp_matches(bare,'^C\d{9}$')"))
st("q", "ST-X-01", "ERROR", "qr", must("connoteNumber", "list_contains(fcons, connoteNumber)"), f"{NOT_SSCC} and len(fcons) > 0")
st("q", "ST-X-02", "ERROR", "qr", must("freightItemNumber", "list_contains(fids, freightItemNumber)"), f"{NOT_SSCC} and len(fids) > 0")
st("r", "ST-LOC-02", "INFO", "routing", shaped("depot", "^[A-Z0-9]{2,3}$", "manual_review"), "variant = 'express'")
st("r", "ST-LOC-01", "INFO", "routing", shaped("depot", "^[A-Z0-9]{2,3}$", "manual_review"), "variant = 'premium'")
st("q", "ST-FPP-01", "ERROR", "qr", shaped("consignmentQuantity", r"^\s*1\s*$"), "variant = 'fpp'")
st("q", "ST-FPP-02", "ERROR", "product", pf("unitType not in ('PAL','SKI')"), "variant = 'fpp' and unitType <> ''")
st("l", "ST-SSC-01", "CRITICAL", "sscc", pf("nv > 0"), "variant = 'sscc'")
st("l", "ST-SSC-02", "CRITICAL", "sscc", pf("ninv = 0"), "variant = 'sscc'")
st("q", "ST-SSC-06", "ERROR", "sscc", pf("movementTypeIndicator = 'N'"), "variant = 'sscc' and movementTypeIndicator <> ''")
st("l", "ST-SSC-07", "INFO", "sscc", "'pass'", "variant = 'sscc'")
ORACLES["rules_startrack"] = SENR + ", res as (" + " union all ".join(ST_RULES) + ") select * from res"
ST_PANEL = decode(decode("category", SECTION_OF, "category"), PANELS["startrack"], "'other'")
ORACLES["section_tones_startrack"] = f"""with r as (select label_id, status, {ST_PANEL} as panel from ({ORACLES['rules_startrack']})),
 w as (select * from r union all select label_id, status, 'linear' from r where panel in ('routing','atl','freight'))
 select label_id, panel, count(*) as rows, case when bool_or(status='fail') then 'fail' when bool_or(status in ('warning','manual_review')) then 'review' when bool_or(status='pass') then 'pass' else 'neutral' end as tone
 from w group by 1, 2"""

# -- house rules, uploads and totals of a stream -----------------------------------------------------------------------------
HOUSE_SET = "case variant when 'parcel-post' then 'house-parcel' when 'express-post' then 'house-express' when 'returns' then 'house-returns' when 'sscc' then 'house-sscc' else 'house-base' end as rule_set"


def house(src, ident, sev, status, message, expected, actual, where="true"):
    name = f"'{ident}'" if src == "lab" else f"'{ident}' || case when n > 1 then '_' || i else '' end"
    return f"select label_id, {name} as id, {HOUSE_SET}, {sev} as severity, {status} as status, {message} as message, {expected} as expected, {actual} as actual from {src} where {where}"


RECEIVER = LASTL("to_b")
SVC_WANT = "case when service in ('06','49') or not starts_with(service,'0') then 'one of 06, 49' else 'matches ^0' end"
ORACLES["house_rules"] = EPR + " " + " union all ".join([
    house("lab", "HS-01", "'INFO'", pf("ltype is null"), "case when ltype is null then 'No label type is printed.' else 'Label type ' || ltype || ' is printed.' end", "'value absent'", "coalesce(ltype,'absent')"),
    house("arts", "HS-02", "'CRITICAL'", pf("digit=want"), "case when digit=want then 'Check digit requirement met.' else 'Digit ' || digit || ' is wrong (item.expectedCheckDigit = ' || want || ').' end", "'item.expectedCheckDigit = ' || want", "digit", A_OK),
    house("arts", "HS-03", "'WARNING'", pf("length(cand)=21", "warning"), "case when length(cand)=21 then 'Article length requirement met.' else 'Article length requirement not met.' end", "'length 21'", "'length ' || length(cand) || ' (' || cand || ')'", f"{A_OK} and variant <> 'returns'"),
    house("lab", "HS-04", "'WARNING'", f"case when trim({RECEIVER})='' then 'manual_review' when {RECEIVER}=upper({RECEIVER}) then 'pass' else 'fail' end",
          f"case when trim({RECEIVER})='' then 'There is no receiver line.' when {RECEIVER}=upper({RECEIVER}) then 'Capital letters requirement met.' else 'Capital letters requirement not met.' end",
          f"case when trim({RECEIVER})='' then 'value present' else 'fully capitalised' end", f"case when trim({RECEIVER})='' then 'missing' else {RECEIVER} end"),
    house("arts", "HS-05", "case when variant='express-post' then 'WARNING' else 'ERROR' end", pf("service in ('06','49') or starts_with(service,'0')"),
          f"'Service ' || service || case when service in ('06','49') or starts_with(service,'0') then ' is ' else ' is not ' end || {SVC_WANT} || '.'", SVC_WANT, "service", A_OK),
    house("lab", "HS-06", "'WARNING'", "case when not raster then 'not_applicable' when dpi >= 300 then 'pass' else 'warning' end",
          "case when not raster then 'Print resolution does not apply to this label.' when dpi >= 300 then 'Print resolution requirement met.' else 'Print resolution requirement not met.' end",
          "case when raster then 'number between 300 and -' else '' end", "case when raster then cast(dpi as varchar) else '' end"),
    house("arts", "HS-07", "'ERROR'", pf("left(cand,3) in ('JDQ','ABC')", "manual_review"), "case when left(cand,3) in ('JDQ','ABC') then 'Known merchant requirement met.' else 'Article ' || cand || ' has another merchant.' end", "''", "cand", A_OK),
])
ORACLES["stream_totals"] = ORACLES["stream_audit"]
ORACLES["audit_uploads"] = f"select f.* from ({ORACLES['audit_flagship']}) f join ({ORACLES['admit_labels']}) a using (label_id) where a.reject_reason is null"
SOME_FRESH = "case when label_id % 3 = 0 then '9315345' else trim(sscc_company_prefix) end as p, case when label_id % 3 = 0 then '3' else trim(sscc_extension_digit) end as e"
EXPECTED = lambda options: f"{EP}{XS.replace(FRESH, options)}, y as (select label_id, {XCOLS} from xs) select label_id, cast(row(provided, raw, extensionDigit, companyPrefix, reason) as varchar) as said from y"
ORACLES["reaudit_changed"] = f"""with v as (select label_id, case when a.said <> b.said then 2 else 1 end as audited_in from ({EXPECTED(FRESH)}) a join ({EXPECTED(SOME_FRESH)}) b using (label_id))
 select r.*, audited_in from ({ORACLES['reaudit'].replace("'9315345' as p, '3' as e", SOME_FRESH)}) r join v using (label_id)"""
