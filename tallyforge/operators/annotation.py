"""Activities with the library's own links between invoices and payments, and with names, goods, notes and the better classification of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.operators import invoices as I
from tallyforge.operators import linkage
from tallyforge.sources.durable import stored

# Reasons of roles that no merchant's role replaces on a payment, and those of invoices that one does.
FIXED_REASONS = ("override", "invoice_override", "calculation_preference", "own_account", "unsynced_card")
OPEN_REASONS = ("invoice", "invoice_ambiguous")


def linked(invoices: DataFrame, payments: DataFrame, known: DataFrame, preferences: DataFrame, window: int = 3, late: int = 7, names: DataFrame | None = None, owner: tuple[str, ...] = ()) -> DataFrame:
    """(invoice_id, transaction_id, by_hand, outcome): every link there is, found in the order in which one makes another impossible.

    The user's choices come first (``linked``, ``separate``), then the assignment by score (``matched``, ``ambiguous``), then invoices that come later than
    the window from sellers whose late invoices the user linked before (``late``).  What a step settles is stored once and is closed to the next.

    invoices: id, seller, amount, day, currency, neither void nor zero; payments: id, account_id, merchant, amount (paid, positive), day, that may be an invoice's;
    known: id, account_id, merchant, day, currency of all payments that are shown; preferences: invoice_id, transaction_id, decision; all
    but preferences with the columns ``owner``.
    """
    shown = preferences.join(known.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi").unionByName(preferences.filter("decision = 'separate'"))
    fixed = stored(linkage.preferred_links(shown.distinct()), "fixed")
    edges = linkage.candidate_edges(invoices.filter("currency = 'TWD'"), payments, window, names, owner)
    found = stored(linkage.settled(linkage.open_edges(edges, fixed)), "found")
    pairs = fixed.filter("outcome = 'linked'").join(invoices.select(F.col("id").alias("invoice_id"), "seller", "currency", F.col("day").alias("invoice_day")), "invoice_id")
    learned = I.learned_merchants(pairs.join(known.select(F.col("id").alias("transaction_id"), "account_id", "merchant", "day"), "transaction_id"), window, late)
    without = lambda rows, of: rows.join(fixed.filter(F.col(of).isNotNull()).select(F.col(of).alias("id")), "id", "left_anti").join(found.filter(F.col(of).isNotNull()).select(F.col(of).alias("id")), "id", "left_anti")
    after = linkage.late_invoices(without(invoices.filter("currency = 'TWD'"), "invoice_id"), without(payments, "transaction_id"), learned, late)
    out = fixed.select("invoice_id", "transaction_id", F.lit(True).alias("by_hand"), "outcome")
    out = out.unionByName(found.filter("invoice_id is not null").select("invoice_id", "transaction_id", F.lit(False).alias("by_hand"), "outcome"))
    return out.unionByName(after.select("invoice_id", "transaction_id", F.lit(False).alias("by_hand"), F.lit("late").alias("outcome")))


def annotated(items: DataFrame, keys: DataFrame, aliases: DataFrame, classes: DataFrame, sources: DataFrame, previews: DataFrame, notes: DataFrame) -> DataFrame:
    """``items`` with display_name, preview, note, note_of, paid_in_cash, class_source, and the category and role that a matched pair shares.

    items: the unified table; keys: id, primary_key (the matched invoice's merchant, else its own), own_key, one row an id; aliases: merchant_key, display_name,
    paid_in_cash; classes: invoice_id, category_id, source, merchant_role of invoices; sources: id, class_source of transactions; previews: invoice_id, preview;
    notes: kind (``bank_transaction``, ``invoice``), id, note.

    A payment takes its invoice's category where that is better founded; an invoice that a payment shows takes that payment's final category.
    Trades stay as they are.  Every side table is joined by key once, so Spark shuffles or broadcasts each by its measured size.
    """
    trade, invoice = F.col("source") == "investment", F.col("source") == "invoice"
    name = lambda key, as_: aliases.select(F.col("merchant_key").alias(key), F.col("display_name").alias(f"{as_}_name"), F.col("paid_in_cash").alias(f"{as_}_cash"))
    rows = items.join(keys, "id", "left").join(name("primary_key", "_p"), "primary_key", "left").join(name("own_key", "_o"), "own_key", "left")
    told = classes.select("invoice_id", F.col("category_id").alias("_c"), F.col("source").alias("_s"), F.col("merchant_role").alias("_r"))
    rows = rows.join(told, "invoice_id", "left").join(previews, "invoice_id", "left").join(sources, "id", "left")
    # the row's own note, else its partner's
    kind = lambda own: F.when(invoice == own, "invoice").otherwise("bank_transaction")
    rows = rows.withColumns({"_own_kind": kind(F.lit(True)), "_peer": F.when(invoice, F.col("duplicate_of")).otherwise(F.col("invoice_id")), "_peer_kind": kind(F.lit(False))})
    noted = lambda kind_, id_, as_: notes.select(F.col("kind").alias(kind_), F.col("id").alias(id_), F.col("note").alias(as_))
    rows = rows.join(noted("_own_kind", "id", "_note"), ["_own_kind", "id"], "left").join(noted("_peer_kind", "_peer", "_peer_note"), ["_peer_kind", "_peer"], "left")
    source = F.when(~invoice & ~trade, F.coalesce("class_source", F.lit("fallback")))
    given = F.when(F.coalesce("_c", F.lit("other")) != "other", F.col("_c"))
    merged = N.merged_category(F.col("category_id"), source, given, F.col("_s"))
    takes = ~invoice & ~trade & given.isNotNull() & N.takes_invoice(source, F.col("_s"))
    role = F.col("_r").isNotNull() & F.when(invoice, F.col("reason").isin(*OPEN_REASONS) & F.col("duplicate_of").isNull()).otherwise(~trade & ~F.coalesce(F.col("reason").isin(*FIXED_REASONS), F.lit(False))) & F.col("role").isNotNull()
    rows = rows.withColumns(
        {
            "display_name": F.when(~trade, F.coalesce("_p_name", "_o_name")), "paid_in_cash": invoice & F.coalesce("_p_cash", F.lit(False)), "note": F.when(~trade, F.coalesce("_note", "_peer_note")),
            "note_of": F.when(trade, None).when(F.col("_note").isNotNull(), F.col("id")).when(F.col("_peer_note").isNotNull(), F.col("_peer")),
            "class_source": F.when(invoice, F.coalesce("_s", F.lit("fallback"))).when(takes, F.when(F.col("_s") == "override", "invoice").otherwise(F.col("_s"))).otherwise(source),
            "category_id": F.when(invoice, F.coalesce("_c", F.lit("other"))).when(trade, F.col("category_id")).otherwise(merged), "review": F.when(role, "confirmed").otherwise(F.col("review")),
            "role": F.when(role, F.col("_r")).otherwise(F.col("role")), "reason": F.when(role, "merchant_rule").otherwise(F.col("reason")), "preview": F.when(~trade, F.col("preview")),
        }
    )
    # what a payment ends up with is also its invoice's
    final = rows.filter(F.col("source").isin("bank", "card") & F.col("invoice_id").isNotNull()).select(F.col("id").alias("duplicate_of"), F.col("category_id").alias("_final"), F.col("class_source").alias("_final_source"))
    rows = rows.join(final, "duplicate_of", "left")
    shown = invoice & F.col("_final_source").isNotNull()
    rows = rows.withColumns({"category_id": F.when(shown, F.col("_final")).otherwise(F.col("category_id")), "class_source": F.when(shown, F.col("_final_source")).otherwise(F.col("class_source"))})
    return rows.select(*items.columns, "display_name", "preview", "note", "note_of", "paid_in_cash", "class_source")
