
OPERATORS: dict[str, str] = {
    "brand_visibility": "J1 J3 A3",
    "answered_visibility": "J1 J3 A3",
    "brand_annotation": "J1 J2 J3 F13",
    "answered_annotation": "J1 J2 J3 F13",
    "cited_urls": "A4 U2 U3 U4",
    "cited_domains": "A5 U2 U3 U4",
    "pages_of_engine": "F3",
    "url_parts": "T1 T3",
    "domain_counts": "T1",
    "brand_names": "T4 T5 T6",
    "text_keys": "T7 T8",
    "overlap_scores": "T10",
    "benchmark_overlaps": "T10",
    "citation_numbers": "T12 T13",
    "name_mentions": "T21",
    "brands_in_texts": "J1",
    "linked_brands": "J2 W5 F13",
    "source_urls": "A8",
    "top_domains": "A7 O1 O2",
    "company_names": "T11",
    "first_events": "A9",
    "last_events": "A10",
    "attribute_sections": "T23",
    "usage_cost": "A1 A2 F2 T24 X4",
    "order_trends": "W1 W3 W6",
    "array_trends": "W1 W3",
    "money_and_months": "M1 M2 D2",
    "taxonomy_errors": "V1",
    "labels_outside": "V2",
    "name_distance": "T14",
    "sampled_records": "O3",
    "page_structure": "H1 H2",
    "page_statistics": "A15",
    "console_records": "F10",
    "keyword_metrics": "F11 W1 W3 W6",
    "cited_answers": "J4 R2",
    "chat_sources": "J10 N3",
    "company_sources": "J7",
    "source_categories": "J6 L30 F12",
    "funnel_taxonomy": "K1 R1",
    "event_windows": "2.11",
    "turn_intents": "L1 L2 L6",
    "supported_statements": "J5",
    "page_parts": "H1 H3 H4 H5 H6 H7 H8 W2",
    "page_means": "A11 A12 A13",
    "nested_overviews": "N2 J9 T25",
}
