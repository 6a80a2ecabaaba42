"""Queries of this subpackage and the SQL of those that have one."""

from __future__ import annotations

from siftwright.llm import bundles, components, copies, leak, ledger, overlap, packing, quota, residue


def queries() -> dict:
    return {
        "p1_found": overlap.p1_found,
        "p1_split_report": overlap.p1_split_report,
        "p2_found": components.p2_found,
        "p2_group_sizes": components.p2_group_sizes,
        "p3_ledger_sample": ledger.p3_ledger_sample,
        "p4_found": quota.p4_found,
        "p4_report": quota.p4_report,
        "p4_sample": quota.p4_sample,
        "p4_drawn": quota.p4_drawn,
        "p5_found": bundles.p5_found,
        "p5_splits": bundles.p5_splits,
        "p5_split_report": bundles.p5_split_report,
        "p6_found": copies.p6_found,
        "p6_copy_counts": copies.p6_copy_counts,
        "p7_packed": packing.p7_packed,
        "p7_fill_report": packing.p7_fill_report,
        "p8_found": leak.p8_found,
        "p8_item_report": leak.p8_item_report,
        "p8_cleaned": leak.p8_cleaned,
        "p9_found": residue.p9_found,
        "p9_message_groups": residue.p9_message_groups,
        "p9_kept": residue.p9_kept,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": components.P2_SQL,
        "p2_group_sizes": components.P2_SIZES_SQL,
        "p3_ledger_sample": ledger.P3_SQL,
        "p4_found": quota.P4_SQL,
        "p4_drawn": quota.P4_DRAWN_SQL,
        "p5_found": bundles.P5_SQL,
    }
