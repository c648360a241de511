"""Delivery gate: companies in, approved and open contacts out."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.config import EmailRules, Product, Sender
from leadloom.operators import contacts as ct, reports


def run(companies: DataFrame, include_external: bool = True, rules: EmailRules = EmailRules(),
        sender: Sender = Sender(), product: Product = Product()) -> dict[str, DataFrame]:
    retained = ct.review_contacts(ct.contact_list(companies, True, True, True, rules), include_external, rules)
    approved = retained.where(F.col("delivery_status") == "approved")
    letters = ct.draft_letters(approved, sender, product)
    return {"retained": reports.contacts_with_letters(retained, letters), "approved": approved,
            "needs_review": retained.where(F.col("delivery_status") != "approved"), "letters": letters,
            "owners": ct.contact_owners(ct.contact_variants(companies, rules)), "totals": reports.contact_totals(retained)}
