"""Queries and SQL of the operators tagged llm."""

from __future__ import annotations

from braidwork.llm import chunks, defects, grouping, handwritten, leaks, lookalike, overlap, packing, vptree
from braidwork.session import table

QUERIES = {
    "p1_found": lambda spark, d: overlap.overlapping_pairs(table(spark, d, "qna_pairs")),
    "p1_classes": lambda spark, d: overlap.overlap_members(table(spark, d, "qna_pairs")),
    "p1_links": lambda spark, d: overlap.overlap_classes(table(spark, d, "qna_pairs"))[1],
    "p1_report": lambda spark, d: overlap.overlap_report(table(spark, d, "qna_pairs")),
    "p2_found": lambda spark, d: chunks.cut_kinds(table(spark, d, "commits")),
    "p2_pieces": lambda spark, d: chunks.long_diff_pieces(table(spark, d, "commits")),
    "p3_found": lambda spark, d: defects.defective_pairs(table(spark, d, "qna_pairs"), table(spark, d, "documents")),
    "p3_labels": lambda spark, d: defects.defect_labels(table(spark, d, "qna_pairs"), table(spark, d, "documents")),
    "p3_validation": lambda spark, d: defects.validation_report(table(spark, d, "qna_pairs"), table(spark, d, "documents")),
    "p4_found": lambda spark, d: vptree.similar_pairs(table(spark, d, "commits")),
    "p4_classes": lambda spark, d: vptree.similar_members(table(spark, d, "commits")),
    "p4_links": lambda spark, d: vptree.similar_links(table(spark, d, "commits"))[1],
    "p4_nearest_diff": lambda spark, d: vptree.nearest_rows(table(spark, d, "commits"), "diff_embedding"),
    "p4_nearest_state": lambda spark, d: vptree.nearest_rows(table(spark, d, "commits"), "repo_state_embedding"),
    "p6_found": lambda spark, d: grouping.straddling(table(spark, d, "snapshots"), table(spark, d, "repo_links")),
    "p6_split": lambda spark, d: grouping.grouped_split(table(spark, d, "snapshots"), table(spark, d, "repo_links")),
    "p7_found": lambda spark, d: handwritten.file_kinds(table(spark, d, "file_changes"), table(spark, d, "blobs")).select("repo_id", "path"),
    "p7_kinds": lambda spark, d: handwritten.file_kinds(table(spark, d, "file_changes"), table(spark, d, "blobs")),
    "p7_signals": lambda spark, d: handwritten.signal_counts(table(spark, d, "file_changes"), table(spark, d, "blobs")),
    "p7_hand_written": lambda spark, d: handwritten.hand_written(table(spark, d, "file_changes"), table(spark, d, "blobs"), table(spark, d, "snapshots")),
    "p8_windows": lambda spark, d: packing.document_windows(table(spark, d, "documents")),
    "p8_report": lambda spark, d: packing.packing_report(table(spark, d, "documents")),
    "p9_found": lambda spark, d: leaks.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id"),
    "p9_proximity": lambda spark, d: leaks.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"), slop=2, least=10),
    "p10_found": lambda spark, d: lookalike.look_alike_pairs(table(spark, d, "documents")),
    "p10_canonical": lambda spark, d: lookalike.canonical_texts(table(spark, d, "documents")),
    "p10_classes": lambda spark, d: lookalike.look_classes(table(spark, d, "documents")),
}

ORACLE = {
    "p2_found": r"""
        with d as (select distinct commit_sha, production_code_diff as t from commits where length(production_code_diff) > 4000)
        select commit_sha, case when list_max(list_transform(regexp_split_to_array(t, '\r\n|\n|\r'), lambda x: length(x))) > 4000 then 'forced' else 'boundary' end as cut_kind from d""",
    "p6_found": r"""
        with recursive n as (
            select 1 as k, repo_id as s from snapshots union all select 2, repo_id from repo_links union all select 3, linked_repo_id from repo_links),
        p as (select distinct s, regexp_extract(regexp_replace(lower(regexp_replace(s, '\s+', '', 'g')), '(/|\.git)+$', ''), '([^/:@]+/[^/:@]+)$', 1) as project from n where s is not null),
        e as (select a.project as u, b.project as v from repo_links l join p a on a.s = l.repo_id join p b on b.s = l.linked_repo_id where link_kind in ('fork_of', 'renamed_to', 'mirror_of')),
        b as (select u, v from e union select v, u from e),
        r as (select distinct project as x, project as y from p union select r.x, b.v from r join b on r.y = b.u),
        c as (select x as project, min(y) as component from r group by x),
        m as (select s.repo_id, s.cross_repo_split, c.component from snapshots s join p on p.s = s.repo_id join c using (project)),
        w as (select component from m group by component having count(distinct cross_repo_split) > 1)
        select distinct repo_id from m where component in (select component from w)""",
}
