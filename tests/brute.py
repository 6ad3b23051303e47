"""Plain definitions of the duplicate levels, for small inputs."""

from __future__ import annotations

from itertools import combinations

CODES = {1: 50, 2: 40, 3: 30, 4: 15, 5: 25}


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            kept = row[j]
            row[j] = previous + 1 if x == y else max(row[j], row[j - 1])
            previous = kept
    return row[-1]


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs(a, b) / total


def similarity(a: str, b: str) -> float:
    a, b = a.strip(), b.strip()
    tokens = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return round(max(tokens, ratio(a, b)), 2)


def level(a: dict, b: dict) -> int | None:
    same_company = a["company_id"] is None or b["company_id"] is None or a["company_id"] == b["company_id"]
    same_vendor = a["vendor_id"] is not None and a["vendor_id"] == b["vendor_id"] and same_company
    number_a, number_b = ((x["invoice_number"] or "").strip() for x in (a, b))
    if number_a and number_a.lower() == number_b.lower() and same_company:
        return 1
    gap = None
    if a["cents"] is not None and b["cents"] is not None:
        gap = abs(a["cents"] - b["cents"])
    days = None
    if a["day"] is not None and b["day"] is not None:
        days = abs(a["day"] - b["day"])
    if same_vendor and gap is not None and gap <= 1 and days == 0:
        return 2
    if same_vendor and gap is not None and gap <= 100 and similarity(number_a, number_b) >= 90:
        return 3
    if same_vendor and gap is not None and gap <= 1 and days is not None and days <= 3:
        return 4
    if same_company and a["items"] and b["items"] and sorted(a["items"]) == sorted(b["items"]):
        return 5
    return None


def all_pairs(invoices: list[dict], scanned: set[int] | None = None) -> dict[tuple[int, int], int]:
    found = {}
    for a, b in combinations(sorted(invoices, key=lambda x: x["invoice_id"]), 2):
        if scanned is not None and a["invoice_id"] not in scanned and b["invoice_id"] not in scanned:
            continue
        matched = level(a, b)
        if matched:
            found[a["invoice_id"], b["invoice_id"]] = matched
    return found
