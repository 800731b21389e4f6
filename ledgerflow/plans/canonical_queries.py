"""Canonical layer, label, merchant, statement and feed queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import taxonomy as X
from ..operators import canonical as C
from ..operators import splits as L
from ..sources.views import EV, TX, canonical_events, canonical_txns
from .panel_queries import _sql, rounded
from .registry import register
from .split_queries import _time

_values = lambda m: ", ".join(f"('{a}', '{b}')" for a, b in m.items())


def raw_feed(spark, sf_dir):
    """A feed with text amounts, mixed signs and some bad values, derived from the transactions."""
    t = canonical_txns(spark, sf_dir)
    bad = F.col("is_recurring") & (F.col("direction") == "credit")
    return t.select("user_id", F.when(bad, "n/a").otherwise(F.concat(F.lit("-"), F.col("amount").cast("string"))).alias("amount"),
        F.when(F.col("merchant_key").startswith("pos"), F.lit("unknown")).otherwise(F.col("timestamp").cast("string")).alias("date"),
        F.when(F.col("direction") == "credit", "income").otherwise("expense").alias("type"), F.col("merchant_raw").alias("merchant"), "transaction_id")


FEED = f"""{TX}, feed AS (SELECT user_id, CASE WHEN is_recurring AND direction = 'credit' THEN 'n/a' ELSE '-' || CAST(amount AS VARCHAR) END AS amount,
  CASE WHEN merchant_key LIKE 'pos%' THEN 'unknown' ELSE CAST(timestamp AS VARCHAR) END AS date, CASE direction WHEN 'credit' THEN 'income' ELSE 'expense' END AS type, merchant_raw AS merchant, transaction_id FROM txns)"""


@register("S7", _sql(FEED, """SELECT user_id, transaction_id, CAST(CAST(try_cast(date AS TIMESTAMP) AS DATE) AS VARCHAR) AS day, round(abs(coalesce(try_cast(amount AS DOUBLE), 0)), 2) AS amount, CASE type WHEN 'income' THEN 'credit' ELSE 'debit' END AS direction,
  merchant AS merchant_raw, merchant AS merchant_normalized, regexp_replace(lower(trim(merchant)), '[^a-z0-9]', '_', 'g') AS merchant_key, merchant AS description, 'misc' AS category, 'feed' AS source, 'INR' AS currency, CAST(1 AS DOUBLE) AS confidence, false AS is_recurring
  FROM feed WHERE try_cast(date AS TIMESTAMP) IS NOT NULL"""))
def s7(spark, sf_dir):
    d = C.canonicalize(raw_feed(spark, sf_dir), "feed")
    return rounded(d.select("user_id", "transaction_id", F.col("timestamp").cast("date").alias("day"), "amount", "direction", "merchant_raw", "merchant_normalized", "merchant_key", "description", "category", "source", "currency", "confidence", "is_recurring"), 2)


@register("P2", _sql(FEED, "SELECT transaction_id, CASE type WHEN 'income' THEN 'credit' ELSE 'debit' END AS direction FROM feed"))
def p2(spark, sf_dir):
    return raw_feed(spark, sf_dir).select("transaction_id", F.when(F.col("type") == "income", "credit").otherwise("debit").alias("direction"))


VALID = f"{FEED}, checked AS (SELECT transaction_id, CASE WHEN try_cast(amount AS DOUBLE) > 0 THEN 'credit' ELSE 'debit' END AS direction, list_filter([CASE WHEN user_id IS NULL THEN 'missing user_id' END, CASE WHEN try_cast(date AS TIMESTAMP) IS NULL THEN 'bad timestamp' END, CASE WHEN try_cast(amount AS DOUBLE) IS NULL THEN 'bad amount' END], lambda e: e IS NOT NULL) AS errors FROM feed)"


def _checked(spark, sf_dir):
    return C.validate(raw_feed(spark, sf_dir).withColumnRenamed("date", "timestamp"))


@register("P3", _sql(VALID, "SELECT transaction_id, direction, array_to_string(errors, ',') AS errors FROM checked"))
def p3(spark, sf_dir):
    return _checked(spark, sf_dir).select("transaction_id", "direction", F.array_join("errors", ",").alias("errors"))


@register("P4", _sql(VALID, "SELECT reason, count(*) AS n FROM (SELECT unnest(errors) AS reason FROM checked) GROUP BY reason"))
def p4(spark, sf_dir):
    return _checked(spark, sf_dir).select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("P7", _sql(TX, "SELECT transaction_id, round(least(10, greatest(0, coalesce(CAST(amount AS DOUBLE), 0) / (10000 + 1e-9))), 4) AS guarded FROM txns"))
def p7(spark, sf_dir):
    a = F.col("amount").cast("double")
    finite = F.when(F.isnan(a) | (F.abs(a) == float("inf")), 0.0).otherwise(F.coalesce(a, F.lit(0.0)))
    return rounded(canonical_txns(spark, sf_dir).select("transaction_id", F.least(F.lit(10.0), F.greatest(F.lit(0.0), finite / (10000 + 1e-9))).alias("guarded")))


@register("F4", _sql(TX, "SELECT DISTINCT merchant_raw, merchant_key FROM txns"))
def f4(spark, sf_dir):
    return canonical_txns(spark, sf_dir).select("merchant_raw", S.merchant_key(F.col("merchant_raw")).alias("merchant_key")).distinct()


MAP = TX + r""", m AS (SELECT merchant_raw, trim(merchant_raw) AS t, trim(regexp_replace(trim(merchant_raw), '\s*(upi|ref|txn|pos|paytm\*|#)\s*\d*', '', 'gi')) AS c FROM (SELECT DISTINCT merchant_raw FROM txns)),
mmap AS (SELECT merchant_raw, n AS merchant_normalized, regexp_replace(replace(lower(n), ' ', '_'), '[^a-z0-9_]', '', 'g') AS merchant_key, stage FROM (SELECT merchant_raw, CASE WHEN c <> '' AND c <> t THEN c ELSE t END AS n, CASE WHEN c <> '' AND c <> t THEN 'regex' ELSE 'exact' END AS stage FROM m))"""


@register("F5", _sql(MAP, "SELECT * FROM mmap"))
def f5(spark, sf_dir):
    return C.merchant_map(canonical_txns(spark, sf_dir))


@register("J3", _sql(MAP, "SELECT transaction_id, coalesce(p.merchant_normalized, t.merchant_raw) AS merchant_normalized FROM txns t LEFT JOIN mmap p USING (merchant_raw)"))
def j3(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    return t.join(C.merchant_map(t), "merchant_raw", "left").select("transaction_id", F.coalesce("merchant_normalized", "merchant_raw").alias("merchant_normalized"))


_FORM = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), 'upi/|ref\s*\d+|txn\s*\d+', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@register("F6", _sql(TX, f"SELECT DISTINCT merchant_raw, {_FORM('merchant_raw')} AS form FROM txns"))
def f6(spark, sf_dir):
    return canonical_txns(spark, sf_dir).select("merchant_raw", S.resolver_form(F.col("merchant_raw")).alias("form")).distinct()


@register("J8", _sql(_time([0.8]), f""", tr AS (SELECT merchant_raw AS merchant, min(timestamp) AS first_seen FROM split WHERE split = 'train' AND trim(merchant_raw) <> '' GROUP BY 1), forms AS (SELECT {_FORM('merchant')} AS form, arg_min(merchant, (first_seen, merchant)) AS by_form FROM tr WHERE {_FORM('merchant')} <> '' GROUP BY 1),
q AS (SELECT DISTINCT merchant_raw AS merchant FROM split WHERE split = 'test')
SELECT q.merchant, coalesce(tr.merchant, by_form, q.merchant, 'UNKNOWN_MERCHANT_KEY') AS resolved, CASE WHEN coalesce(tr.merchant, by_form) IS NULL THEN 'UNKNOWN_MERCHANT' ELSE 'KNOWN_MERCHANT' END AS state FROM q LEFT JOIN tr ON q.merchant = tr.merchant LEFT JOIN forms ON {_FORM('q.merchant')} = form"""))
def j8(spark, sf_dir):
    t = L.temporal_split(canonical_txns(spark, sf_dir))
    train = t.where("split = 'train'").select(F.col("merchant_raw").alias("merchant"), F.col("timestamp").alias("first_seen"))
    return C.resolve(t.where("split = 'test'").select(F.col("merchant_raw").alias("merchant")).distinct(), train)


#: Labels of the transactions' descriptions, and of a few foreign taxonomies, by line.
_LABEL = "CASE length(description) % 4 WHEN 0 THEN category WHEN 1 THEN upper(replace(category, '_', ' & ')) WHEN 2 THEN split_part(description, ' ', 1) ELSE category || ' Services' END"
_ALIAS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(X.ALIASES))
NORM = f"""{TX}, aliases(rank, token, hit) AS (VALUES {_ALIAS}), labels_ AS (SELECT DISTINCT lower(trim({_LABEL})) AS label FROM txns),
held AS (SELECT label, arg_min(hit, rank) AS hit FROM labels_ JOIN aliases ON contains(label, token) GROUP BY label),
norm AS (SELECT label, coalesce((SELECT hit FROM aliases WHERE token = label), hit, CASE WHEN label IN ({", ".join(f"'{c}'" for c in (*X.EXPENSE_CATEGORIES, X.INCOME))}) THEN label END, 'misc') AS normalized FROM labels_ LEFT JOIN held USING (label))"""


@register("F7", _sql(NORM, "SELECT label, normalized FROM norm"))
def f7(spark, sf_dir):
    labels = canonical_txns(spark, sf_dir).select(F.lower(F.trim(F.expr(_LABEL))).alias("label")).distinct()
    return C.normalize_category(labels, "label", "normalized")


#: Rules for the words of these tables' descriptions, before the default ones.
RULES = X.brand_rules((("promo", "subscriptions"), ("gizmo", "entertainment"), ("gear", "transportation"), ("bolt", "housing"), ("widget", "shopping"), *X.DEFAULT_RULES))
_RULES = ", ".join(f"({r}, '{t}', '{c}')" for r, t, c in RULES)
BRAND = f"{TX}, rules(rank, token, hit) AS (VALUES {_RULES}), brand AS (SELECT description, arg_min(hit, rank) AS brand FROM (SELECT DISTINCT description FROM txns) JOIN rules ON contains(lower(description), token) GROUP BY description)"


@register("J7", _sql(BRAND, "SELECT description, brand FROM brand"))
def j7(spark, sf_dir):
    d = canonical_txns(spark, sf_dir).select("description").distinct()
    return C.first_contained(d, "description", RULES, "brand").where("brand IS NOT NULL")


@register("F8", _sql(BRAND, "SELECT transaction_id, brand FROM txns LEFT JOIN brand USING (description)"))
def f8(spark, sf_dir):
    return C.first_contained(canonical_txns(spark, sf_dir).select("transaction_id", "description"), "description", RULES, "brand").select("transaction_id", "brand")


_CONF = "CAST(('0x' || substr(md5(transaction_id), 1, 4))::BIGINT % 100 AS DOUBLE) / 100"


@register("P8", _sql(BRAND, f"SELECT transaction_id, CASE WHEN {_CONF} >= 0.5 THEN category ELSE coalesce(brand, 'transfer') END AS routed, CASE WHEN {_CONF} >= 0.5 THEN 'ml-model' WHEN brand IS NOT NULL THEN 'brand-rule' ELSE 'p2p/uncat' END AS route FROM txns LEFT JOIN brand USING (description)"))
def p8(spark, sf_dir):
    d = C.first_contained(canonical_txns(spark, sf_dir), "description", RULES, "brand")
    sure = (F.conv(F.substring(F.md5("transaction_id"), 1, 4), 16, 10).cast("long") % 100).cast("double") / 100 >= X.ML_THRESHOLD
    return d.select("transaction_id", F.when(sure, F.col("category")).otherwise(F.coalesce("brand", F.lit("transfer"))).alias("routed"), F.when(sure, "ml-model").when(F.col("brand").isNotNull(), "brand-rule").otherwise("p2p/uncat").alias("route"))


_BUSINESS = " OR ".join(f"contains(lower(trim(name)), '{t}')" for t in X.BUSINESS_TOKENS)


@register("F9", _sql(TX, f"SELECT name, NOT ({_BUSINESS}) AND regexp_matches(replace(name, ' ', ''), '^[A-Za-z]+$') AND length(replace(name, ' ', '')) >= 5 AS person FROM (SELECT DISTINCT unnest([merchant_raw, split_part(description, ' ', 1), split_part(description, ' ', 2) || ' mart']) AS name FROM txns)"))
def f9(spark, sf_dir):
    first, second = F.split_part("description", F.lit(" "), F.lit(1)), F.split_part("description", F.lit(" "), F.lit(2))
    d = canonical_txns(spark, sf_dir).select(F.explode(F.array("merchant_raw", first, F.concat(second, F.lit(" mart")))).alias("name")).distinct()
    return d.select("name", S.person_like(F.col("name"), X.BUSINESS_TOKENS).alias("person"))


_FORMS = r"unnest([upper(replace(replace(t, ' ', ''), '-', '')), replace(replace(t, ' ', ''), '-', ''), t])"


@register("F10", _sql(TX, rf"SELECT description, {_FORMS} AS variant FROM (SELECT description, trim(regexp_replace(description, '\s+', ' ', 'g')) AS t FROM (SELECT DISTINCT description FROM txns))"))
def f10(spark, sf_dir):
    d = canonical_txns(spark, sf_dir).select("description").distinct()
    return d.select("description", F.explode(S.payment_forms(F.col("description"))).alias("variant"))


@register("F11", _sql(TX, r""", names AS (SELECT name, row_number() OVER (ORDER BY md5(name)) - 1 AS i FROM (SELECT DISTINCT split_part(description, ' ', 1) AS name FROM txns) WHERE length(name) > 0), words AS (SELECT DISTINCT split_part(description, ' ', 2) AS word, category FROM txns),
picks AS (SELECT DISTINCT word, category, ('0x' || substr(md5(concat_ws('|', word || category || k, '42')), 1, 8))::BIGINT % (SELECT count(*) FROM names) AS i FROM words, (VALUES ('0'), ('1')) ks(k)),
combos AS (SELECT name || ' ' || word AS t, category FROM picks JOIN names USING (i))
SELECT category, """ + _FORMS + r" AS variant FROM combos"))
def f11(spark, sf_dir):
    """Name and word combinations, a hashed two of each word, in all payment forms; names are drawn by number."""
    from pyspark.sql import Window as W

    t = canonical_txns(spark, sf_dir)
    part = lambda k: F.split_part("description", F.lit(" "), F.lit(k))
    names = t.select(part(1).alias("name")).distinct().where("length(name) > 0").withColumn("h", F.md5("name")).withColumn("b", F.substring("h", 1, 3))
    before = names.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("b")) - F.col("n")).drop("n")
    names = names.join(before, "b").select("name", (F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h")) - 1).alias("i"))
    words = t.select(part(2).alias("word"), "category").distinct()
    picks = words.withColumn("k", F.explode(F.array(F.lit("0"), F.lit("1")))).select("word", "category", S.hash_bucket(F.concat("word", "category", "k"), 42, max(1, names.count())).cast("long").alias("i")).distinct()
    d = picks.join(names, "i").withColumn("t", F.concat_ws(" ", "name", "word"))
    return d.select("category", F.explode(S.payment_forms(F.col("t"))).alias("variant"))


@register("F12", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f12(spark, sf_dir):
    from ..sources.views import table

    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def statement_lines(spark, sf_dir):
    """Statements made of the transactions, a document a user: a date line, a row line, then totals."""
    from pyspark.sql import Window as W

    t = canonical_txns(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("timestamp", "transaction_id")))
    row = F.concat(F.when(F.col("direction") == "credit", "Received from ").otherwise("Paid to "), "merchant_raw", F.lit(" ₹ "), F.col("amount").cast("string"))
    dated = F.when(F.col("n") > 2, F.date_format("timestamp", "MMM dd, yyyy")).otherwise("Statement")
    rows = t.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(F.struct((2 * F.col("n")).alias("line_no"), dated.alias("text")), F.struct((2 * F.col("n") + 1).alias("line_no"), row.alias("text")))).alias("x")).select("doc_id", "page", "x.*")
    part = lambda d: F.sum(F.when((F.col("direction") == d) & (F.col("n") > 2), F.col("amount")).otherwise(0))
    sums = t.groupBy("user_id").agg(part("debit").alias("d"), part("credit").alias("c"))
    sums = sums.where("user_id NOT LIKE '%7'")  # some statements print no totals
    printed = sums.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(
        F.struct(F.lit(1_000_000).alias("line_no"), F.concat(F.lit("Total Debits ₹ "), F.col("d").cast("string")).alias("text")),
        F.struct(F.lit(1_000_001).alias("line_no"), F.concat(F.lit("Total Credits ₹ "), (F.col("c") + (F.length("user_id") % 2) * 5).cast("string")).alias("text")))).alias("x")).select("doc_id", "page", "x.*")
    return rows.unionByName(printed)


ST = f"{TX}, num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id) AS n FROM txns)"


@register("S5", _sql(ST, "SELECT user_id AS doc_id, CAST(2 * n + 1 AS INT) AS line_no, direction, merchant_raw, CAST(amount AS DOUBLE) AS amount, CASE WHEN n > 2 THEN CAST(CAST(timestamp AS DATE) AS VARCHAR) END AS day, CASE WHEN n <= 2 THEN 'Missing or invalid timestamp' END AS rejected FROM num"))
def s5(spark, sf_dir):
    d = C.statement_rows(statement_lines(spark, sf_dir))
    return d.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "direction", "merchant_raw", F.col("amount").cast("double").alias("amount"), F.col("timestamp").cast("date").cast("string").alias("day"), "rejected")


@register("S6", _sql(ST, "SELECT user_id AS doc_id, CAST(sum(CASE WHEN direction = 'debit' AND n > 2 THEN amount ELSE 0 END) AS DOUBLE) AS debit_extracted, CAST(sum(CASE WHEN direction = 'credit' AND n > 2 THEN amount ELSE 0 END) AS DOUBLE) AS credit_extracted, CASE WHEN user_id LIKE '%7' THEN 'NO_STATEMENT_TOTALS' WHEN length(user_id) % 2 = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM num GROUP BY user_id"))
def s6(spark, sf_dir):
    return C.reconcile(statement_lines(spark, sf_dir)).select("doc_id", F.col("debit_extracted").cast("double").alias("debit_extracted"), F.col("credit_extracted").cast("double").alias("credit_extracted"), "status")


_cc = list(X.CARD_CATEGORIES)
CARD = f"{TX}, card AS (SELECT transaction_id, user_id AS cc_num, ({_cc + ['unmapped']!r})[CAST(('0x' || substr(md5(description), 1, 4))::BIGINT % {len(_cc) + 1} AS INT) + 1] AS category, 'fraud_' || merchant_raw AS merchant, amount AS amt FROM txns)"


def card_feed(txns, raw_category="category", keep_percent=100):
    """Card rows to canonical columns: mapped category or dropped, merchant prefix stripped, users sampled."""
    d = txns.withColumn("category", C.mapped(F.col(raw_category), X.CARD_CATEGORIES)).where("category IS NOT NULL AND amt > 0")
    users = d.select("cc_num").distinct().where(S.hash_bucket(F.col("cc_num"), 42, 100) < keep_percent)
    return d.join(users, "cc_num", "left_semi").withColumn("description", F.replace("merchant", F.lit("fraud_"), F.lit("")))


@register("S8", _sql(CARD, f", cmap(raw, cat) AS (VALUES {_values(X.CARD_CATEGORIES)}) SELECT transaction_id, cat AS category, replace(merchant, 'fraud_', '') AS description FROM card JOIN cmap ON category = raw WHERE amt > 0 AND CAST(('0x' || substr(md5(concat_ws('|', cc_num, '42')), 1, 8))::BIGINT % 100 AS INT) < 50"))
def s8(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(c) for c in [*_cc, "unmapped"]]), (F.conv(F.substring(F.md5("description"), 1, 4), 16, 10).cast("long") % (len(_cc) + 1) + 1).cast("int"))
    t = canonical_txns(spark, sf_dir).select("transaction_id", F.col("user_id").alias("cc_num"), raw.alias("category"), F.concat(F.lit("fraud_"), "merchant_raw").alias("merchant"), F.col("amount").alias("amt"))
    return card_feed(t, keep_percent=50).select("transaction_id", "category", "description")


def tracker_feed(monthly):
    """A monthly row to income, housing, loan and the rest, each capped by what is left of the total."""
    total = F.when(F.col("expense_total") > 0, F.col("expense_total")).otherwise(F.col("essential") + F.col("discretionary"))
    d = monthly.withColumn("total", total).withColumn("housing", F.least("rent", "total")).withColumn("loan_paid", F.least("loan", F.col("total") - F.col("housing")))
    label = F.coalesce(C.mapped(F.lower(F.trim("category")), X.TRACKER_CATEGORIES), F.lit("misc"))
    label = F.when(label.isin("housing", "financial"), "misc").otherwise(label)
    part = lambda kind, category, amount: F.struct(F.lit(kind).alias("type"), category.alias("category"), amount.cast("decimal(18,2)").alias("amount"))
    parts = F.array(part("income", F.lit("income"), F.col("income")), part("expense", F.lit("housing"), F.col("housing")), part("expense", F.lit("financial"), F.col("loan_paid")), part("expense", label, F.col("total") - F.col("housing") - F.col("loan_paid")))
    return d.select(F.concat(F.lit("pf_"), "user_id").alias("user_id"), "date", F.explode(parts).alias("p")).select("user_id", "date", "p.*").where("amount > 0")


_MONTHLY = "sum(CASE WHEN direction = 'credit' THEN amount ELSE 0 END) AS income, sum(CASE WHEN direction = 'debit' THEN amount ELSE 0 END) AS expense_total, sum(CASE WHEN category = 'housing' THEN amount * 3 ELSE 0 END) AS rent, sum(CASE WHEN category = 'financial' THEN amount * 2 ELSE 0 END) AS loan, sum(CASE WHEN category = 'groceries' THEN amount ELSE 0 END) AS essential, sum(CASE WHEN category = 'misc' THEN amount ELSE 0 END) AS discretionary, max(CASE WHEN category IN ('groceries', 'transportation', 'entertainment') THEN category END) AS category"


@register("S9", _sql(TX, f""", mon AS (SELECT user_id, CAST(CAST(date_trunc('month', timestamp) AS DATE) AS VARCHAR) AS date, {_MONTHLY} FROM txns GROUP BY 1, 2), tot AS (SELECT *, CASE WHEN expense_total > 0 THEN expense_total ELSE essential + discretionary END AS total FROM mon),
h AS (SELECT *, least(rent, total) AS housing FROM tot), l AS (SELECT *, least(loan, total - housing) AS loan_paid FROM h)
SELECT 'pf_' || user_id AS user_id, date, type, category, CAST(amount AS DOUBLE) AS amount FROM (SELECT user_id, date, 'income' AS type, 'income' AS category, income AS amount FROM l UNION ALL SELECT user_id, date, 'expense', 'housing', housing FROM l UNION ALL SELECT user_id, date, 'expense', 'financial', loan_paid FROM l
UNION ALL SELECT user_id, date, 'expense', coalesce(category, 'misc'), total - housing - loan_paid FROM l) WHERE amount > 0"""))
def s9(spark, sf_dir):
    t = canonical_txns(spark, sf_dir).withColumn("date", S.month_start().cast("string"))
    mon = t.groupBy("user_id", "date").agg(*[F.expr(x.strip()) for x in _split_top(_MONTHLY)])
    return tracker_feed(mon).withColumn("amount", F.col("amount").cast("double"))


def _split_top(text):
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


_bank = [*X.BANK_CATEGORIES, "Peer Transfer"]
BANK = f"{TX}, bank AS (SELECT transaction_id, user_id, timestamp, direction, CASE direction WHEN 'credit' THEN CASE WHEN is_recurring THEN 'Salary' ELSE 'Peer Transfer' END ELSE ({_bank!r})[CAST(('0x' || substr(md5(description), 1, 4))::BIGINT % {len(_bank)} AS INT) + 1] END AS label FROM txns)"


def bank_feed(rows, min_months=4):
    """Salary credits as income and mapped debits, for users with enough distinct months."""
    salary = rows.where("label = 'Salary' AND direction = 'credit'").withColumn("category", F.lit("income"))
    spent = rows.where("direction = 'debit'").withColumn("category", C.mapped(F.col("label"), X.BANK_CATEGORIES)).where("category IS NOT NULL")
    both = spent.unionByName(salary)
    steady = both.groupBy("user_id").agg(F.countDistinct(S.month_start()).alias("months")).where(F.col("months") >= min_months)
    return both.join(steady, "user_id", "left_semi").withColumn("user_id", F.concat(F.lit("in_"), "user_id"))


@register("S10", _sql(BANK, f", bmap(raw, cat) AS (VALUES {_values(X.BANK_CATEGORIES)}), both_ AS (SELECT transaction_id, user_id, timestamp, cat AS category FROM bank JOIN bmap ON label = raw WHERE direction = 'debit' UNION ALL SELECT transaction_id, user_id, timestamp, 'income' FROM bank WHERE label = 'Salary' AND direction = 'credit') SELECT transaction_id, 'in_' || user_id AS user_id, category FROM both_ WHERE user_id IN (SELECT user_id FROM both_ GROUP BY user_id HAVING count(DISTINCT date_trunc('month', timestamp)) >= 12)"))
def s10(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(c) for c in _bank]), (F.conv(F.substring(F.md5("description"), 1, 4), 16, 10).cast("long") % len(_bank) + 1).cast("int"))
    label = F.when(F.col("direction") == "credit", F.when(F.col("is_recurring"), "Salary").otherwise("Peer Transfer")).otherwise(pick)
    return bank_feed(canonical_txns(spark, sf_dir).withColumn("label", label), 12).select("transaction_id", "user_id", "category")


_snap = {"Rent": "housing", "Groceries": "groceries", "Transport": "transportation", "Eating_Out": "food_dining", "Utilities": "utilities", "Loan_Repayment": "financial"}


def profile_snapshot(wide):
    """Wide monthly spend columns to the taxonomy, shares and a clipped savings rate."""
    have = [c for c in X.PROFILE_COLUMNS if c in wide.columns]
    out = {c: sum((F.coalesce(F.col(k), F.lit(0.0)) for k in have if X.PROFILE_COLUMNS[k] == c), F.lit(0.0)) for c in X.EXPENSE_CATEGORIES}
    d = wide.select("user_id", F.coalesce("Income", F.lit(0.0)).alias("income"), *[v.alias(c) for c, v in out.items()])
    d = d.withColumn("mean_expense", sum((F.col(c) for c in X.EXPENSE_CATEGORIES), F.lit(0.0)))
    rate = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("mean_expense") / F.nullif("income", F.lit(0.0)))), F.lit(0.0))
    share = lambda c: F.coalesce(F.col(c) / F.nullif("mean_expense", F.lit(0.0)), F.lit(0.0)).alias(f"share_{c}")
    return d.select("user_id", F.log1p("income").alias("log_income"), rate.alias("savings_rate"), F.lit(0.0).alias("volatility"), F.lit(0.0).alias("trend"), "mean_expense", *[share(c) for c in X.EXPENSE_CATEGORIES])


@register("S11", _sql(TX, f""", w AS (SELECT user_id, CAST(coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS DOUBLE) AS income, {', '.join(f"CAST(coalesce(sum(amount) FILTER (category = '{c}'), 0) AS DOUBLE) AS {c}" for c in _snap.values())} FROM txns GROUP BY user_id), m AS (SELECT *, {' + '.join(_snap.values())} AS mean_expense FROM w)
SELECT user_id, round(ln(1 + income), 4) AS log_income, round(coalesce(greatest(-1, least(1, 1 - mean_expense / nullif(income, 0))), 0), 4) AS savings_rate, round(mean_expense, 3) AS mean_expense, round(coalesce(housing / nullif(mean_expense, 0), 0), 4) AS share_housing, round(coalesce(groceries / nullif(mean_expense, 0), 0), 4) AS share_groceries FROM m"""))
def s11(spark, sf_dir):
    t = canonical_txns(spark, sf_dir)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0)).cast("double")
    wide = t.groupBy("user_id").agg(part(F.col("direction") == "credit").alias("Income"), *[part(F.col("category") == c).alias(k) for k, c in _snap.items()])
    d = profile_snapshot(wide)
    return d.select("user_id", *[S.rnd(F.col(c), k).alias(c) for c, k in (("log_income", 4), ("savings_rate", 4), ("mean_expense", 3), ("share_housing", 4), ("share_groceries", 4))])


_JOINED = "replace(replace(trim(regexp_replace(description, '\\s+', ' ', 'g')), ' ', ''), '-', '')"


@register("S12", f"""WITH {TX}, {EV}, j AS (SELECT category AS description, json_keys(props) AS ks, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM evs JOIN events ON transaction_id = CAST(event_id AS VARCHAR)),
  l AS (SELECT description, category FROM txns UNION SELECT description, 'k' || (k % 5) FROM j WHERE len(ks) = 1)
  SELECT DISTINCT * FROM (SELECT unnest([description, upper({_JOINED}), {_JOINED}]) AS description, category FROM l) WHERE length(description) > 1""")
def s12(spark, sf_dir):
    """Labelled texts of two sources, one with labels in JSON, and their payment forms."""
    from ..sources.views import table

    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,long>")).where(F.size("m") == 1)
    tagged = e.select(F.col("event_type").alias("description"), F.concat(F.lit("k"), (F.element_at("m", "k") % 5).cast("string")).alias("category"))
    return C.with_payment_forms(canonical_txns(spark, sf_dir).select("description", "category").unionByName(tagged).distinct())


@register("S13", f"""WITH {TX}, {EV}, u AS (SELECT 'cc_' || user_id AS user_id, 'card' AS source FROM txns UNION ALL SELECT 'in_' || user_id, 'bank' FROM evs UNION ALL SELECT 'pf_' || o_custkey, 'finance_tracker' FROM orders),
  s AS (SELECT source, count(*) AS n, count(DISTINCT user_id) AS users FROM u GROUP BY source)
  SELECT source, coalesce(n, 0) AS n, coalesce(users, 0) AS users, CASE WHEN n > 0 THEN 'OK (' || n || ' rows)' ELSE 'EMPTY' END AS status FROM (VALUES ('card'), ('bank'), ('finance_tracker'), ('uploads')) x(source) LEFT JOIN s USING (source)""")
def s13(spark, sf_dir):
    """All sources in one table with prefixed ids, and the status of each, also of one that has no rows."""
    from ..sources.views import table

    card, bank = canonical_txns(spark, sf_dir).select("user_id"), canonical_events(spark, sf_dir).select("user_id")
    finance = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    union = C.union_sources({"card": ("cc_", card), "bank": ("in_", bank), "finance_tracker": ("pf_", finance)})
    return C.source_status(union, ("card", "bank", "finance_tracker", "uploads"))
