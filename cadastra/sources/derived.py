"""Evidence, ledger and geometry tables derived from the given ones, as SQL for Spark and DuckDB.

Each entry is (Spark SQL, DuckDB SQL); names in braces are other tables. Most texts are the same
for both engines. Every derived table grows with the tables it comes from.
"""

from __future__ import annotations


def _same(text: str) -> tuple[str, str]:
    return text, text


_BLOCK = "document_id, CAST(i AS BIGINT) AS reading_order, CAST(floor(i / 40) AS BIGINT) + 1 AS page_number, raw_text"

_CLAUSE = """
    SELECT o_orderkey AS fragment_id, CAST(o_custkey % 97 + 97 * floor(o_orderkey / 5000) AS BIGINT) AS document_id, o_orderkey AS reading_order,
           CAST(floor(o_orderkey / 500) AS BIGINT) + 1 AS page_number,
           CASE o_orderkey % 24
             WHEN 0 THEN concat('Part ', CAST(o_custkey % 20 AS STRING), ' - General rules')
             WHEN 1 THEN concat('Schedule ', chr(CAST(65 + o_custkey % 6 AS INT)), ': Height precincts')
             WHEN 2 THEN concat('Appendix ', CAST(o_custkey % 9 AS STRING), ' Design manual')
             WHEN 3 THEN concat(CAST(o_custkey % 300 AS STRING), ' Purpose of these rules')
             WHEN 4 THEN concat(CAST(o_custkey % 300 AS STRING), '.', CAST(o_orderkey % 7 AS STRING), ' Lot coverage')
             WHEN 5 THEN concat(CAST(o_custkey % 300 AS STRING), '.', CAST(o_orderkey % 7 AS STRING), '.2.4 Side yards')
             WHEN 6 THEN concat(CAST(o_custkey % 300 AS STRING), '(', CAST(o_orderkey % 9 AS STRING), ') Maximum building height')
             WHEN 7 THEN concat('(', CAST(o_custkey % 30 AS STRING), ') Every owner shall apply')
             WHEN 8 THEN '(a) the use is accessory; and'
             WHEN 9 THEN '(iv) any enclosed lobby'
             WHEN 10 THEN concat('Sections ', CAST(o_custkey % 50 AS STRING), ' to ', CAST(o_custkey % 50 + 3 AS STRING), ' inclusive apply')
             WHEN 11 THEN concat('Subject to section ', CAST(o_custkey % 300 AS STRING), '.', CAST(o_orderkey % 7 AS STRING), ' and schedule b of this By-law')
             WHEN 12 THEN concat('Height is provided in ', CAST(o_custkey % 300 AS STRING), ' for R-', CAST(o_orderkey % 5 AS STRING), ' and HR 1 zones, at least ', CAST(o_orderkey % 90 AS STRING), ' m2')
             WHEN 13 THEN concat('"Lot ', CAST(o_custkey % 40 AS STRING), '" means a parcel of land with 12.5 metres of frontage')
             WHEN 14 THEN concat(CAST(o_orderkey % 90 AS STRING), ' square metres')
             WHEN 15 THEN concat(CAST(o_orderkey % 90 AS STRING), ' ft, except on corner lots')
             WHEN 16 THEN concat('Restaurant use | ', CAST(o_orderkey % 90 AS STRING), ' | yes')
             WHEN 17 THEN CASE o_orderkey % 5 WHEN 0 THEN 'Regional Centre Land Use By-law | Part V' WHEN 1 THEN 'setback as specified on schedule 18' WHEN 2 THEN 'not exceed the maximum required building height specified on Schedule 15.'
               WHEN 3 THEN 'district, any  main building shall' ELSE 'GENERAL PROVISIONS FOR ZONES' END
             WHEN 18 THEN 'PAGE Regional Plan Area'
             WHEN 19 THEN concat('Lot coverage ..... ', CAST(o_orderkey % 90 AS STRING))
             WHEN 20 THEN concat('* notwithstanding Table ', CAST(o_orderkey % 30 AS STRING), 'A a dwelling unit in the CEN-2 zone may have a rear addition')
             WHEN 21 THEN concat('[', CAST(o_orderkey % 9 AS STRING), '] applies to minimum lot area and lot area only')
             WHEN 22 THEN concat(CAST(o_orderkey % 40 AS STRING), ' rue de l''eglise lane')
             ELSE 'A Cluster housing use is permitted; parking is required as set out below.' END AS text
    FROM {orders}"""

_FRAGMENTS = """
    SELECT depth * 1000000000000 + k AS fragment_id,
           CASE WHEN depth > 1 THEN (depth - 1) * 1000000000000 + pk END AS parent_fragment_id,
           document_id, depth, citation_label, k % 200 + 1 AS page_start, k % 200 + 1 + k % 3 AS page_end, k AS reading_order,
           CASE WHEN flag = 'R' THEN 'uncertain' ELSE 'parsed' END AS parse_status,
           CASE depth WHEN 1 THEN 'part' WHEN 2 THEN 'section' WHEN 3 THEN 'subsection' WHEN 4 THEN 'clause' ELSE 'subclause' END AS fragment_type,
           text
    FROM (
        SELECT 1 AS depth, CAST(r_regionkey AS BIGINT) AS k, CAST(NULL AS BIGINT) AS pk, CAST(r_regionkey AS BIGINT) AS document_id,
               concat('Part ', CAST(r_regionkey AS STRING)) AS citation_label, 'N' AS flag, r_name AS text FROM {region}
        UNION ALL
        SELECT 2, n_nationkey, n_regionkey, n_regionkey, CAST(n_nationkey AS STRING), 'N', n_name FROM {nation}
        UNION ALL
        SELECT 3, c_custkey, c_nationkey, n_regionkey, concat(CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)), 'N',
               concat(c_name, ' in the R-', CAST(c_custkey % 5 AS STRING), ' zone')
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION ALL
        SELECT 4, o_orderkey, o_custkey, n_regionkey, concat('(', CAST(o_orderkey AS STRING), ')'), 'N', concat('Order of priority ', o_orderpriority)
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        UNION ALL
        SELECT 5, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity),
               l_orderkey, n_regionkey, concat('(', CAST(l_linenumber AS STRING), ')'), l_returnflag,
               concat('Subject to section ', CAST(l_suppkey AS STRING), '.', CAST(l_linenumber AS STRING))
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
    ) AS parts"""

# The fragment tree with faults: a cycle at the top of document 0, missing parents, ranges of pages that end before they begin.
_FAULTY = """
    SELECT fragment_id,
           CASE WHEN fragment_id = 1000000000000 THEN (SELECT min(fragment_id) FROM {d_fragments} WHERE depth = 2 AND document_id = 0)
             WHEN fragment_id % 997 = 5 THEN 0 WHEN fragment_id % 991 = 7 THEN NULL ELSE parent_fragment_id END AS parent_fragment_id,
           document_id, depth, citation_label, page_start, CASE WHEN fragment_id % 983 = 3 THEN page_start - 1 ELSE page_end END AS page_end, fragment_type, parse_status
    FROM {d_fragments}"""

_OUTLINE = """
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k, ln, p, s, e, q) AS idx, level, label
    FROM (
        SELECT o_custkey AS document_id, o_orderkey AS k, 0 AS ln, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS s, CAST(0 AS DOUBLE) AS e,
               CAST(0 AS DOUBLE) AS q, 2 AS level, CAST(o_orderkey AS STRING) AS label FROM {orders}
        UNION ALL
        SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
               CASE WHEN l_linenumber <= 2 THEN 3 ELSE 4 END, concat(CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING))
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    ) AS rows"""

# One by-law for each customer, one page for each order: sections, clauses, roman items, definitions, contents, values and prose in the order of the lines.
_BYLAWS = """
    SELECT o_custkey AS document_id, l_orderkey AS page_number, l_orderkey * 1000 + rn AS reading_order,
           CASE WHEN rn = 1 AND l_orderkey % 6 = 0 THEN concat('Part ', CAST(l_orderkey % 12 AS STRING), ' Zones')
             WHEN rn = 1 AND l_orderkey % 6 = 1 THEN 'DEFINITIONS' WHEN rn = 2 AND l_orderkey % 6 = 1 THEN 'In this by-law:'
             WHEN rn = 1 THEN concat(CAST(l_orderkey % 400 AS STRING), ' Permitted Uses')
             ELSE CASE (l_partkey + 5 * rn) % 17
               WHEN 0 THEN concat('(', chr(CAST(97 + rn % 8 AS INT)), ') one unit on a lot of ', CAST(l_partkey AS STRING), ' m2;')
               WHEN 1 THEN concat('(', chr(CAST(97 + rn % 8 AS INT)), ') FOR R-', CAST(l_partkey % 9 AS STRING), ' USES')
               WHEN 2 THEN '(i) the width of the lot; and' WHEN 3 THEN '(ii) the depth of the lot.'
               WHEN 4 THEN concat('"Lot ', CAST(l_partkey % 90 AS STRING), '" means a parcel that is:')
               WHEN 5 THEN concat(CAST(l_partkey % 60 AS STRING), ' metres') WHEN 6 THEN 'The height of a wall is'
               WHEN 7 THEN concat(CAST(l_orderkey % 400 AS STRING), '.', CAST(rn AS STRING), ' Side Yards')
               WHEN 8 THEN concat('(', CAST(rn AS STRING), ') No building may be higher than its neighbours.')
               WHEN 9 THEN concat('* signs of type ', CAST(l_partkey % 30 AS STRING)) WHEN 10 THEN concat('[', CAST(rn AS STRING), '] applies to corner lots only')
               WHEN 11 THEN concat('Schedule B\n', 'Homes of all kinds\n', 'Schedule C\n', 'Shops of ', CAST(l_partkey % 9 AS STRING), ' kinds')
               WHEN 12 THEN concat('ZM-1\n', 'Access to water ..... ', CAST(l_partkey % 300 AS STRING), '\n', 'Front yards ..... 9') WHEN 13 THEN 'PARKING OF VEHICLES'
               WHEN 14 THEN 'use | stalls' WHEN 15 THEN concat(CAST(l_orderkey % 400 AS STRING), '(', CAST(rn AS STRING), ') Main buildings')
               ELSE 'a building stands behind the line that the map shows for it.' END END AS raw_text
    FROM (SELECT o_custkey, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
          FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) AS numbered"""

# Zoning by-laws, one for each customer and a page for each order: headings of zones in three forms, rules, uses and parking.
_ZONING = """
    SELECT o_custkey AS document_id, page_number, page_number * 100 + rn AS reading_order, l_orderkey * 1000 + rn AS fragment_id,
           CASE WHEN rn > 1 THEN l_orderkey * 1000 + 1 END AS parent_fragment_id,
           CASE WHEN rn = 1 THEN CASE l_orderkey % 5
               WHEN 0 THEN concat(zone, ' ZONE') WHEN 1 THEN concat('Built form and siting requirements within the ', zone, ' zone') WHEN 2 THEN 'YARD AND HEIGHT RULES'
               WHEN 3 THEN concat('Requirements of the ', zone, ' zone') ELSE concat('Where any building stands in ', zone, ' it shall comply with the following requirements') END
             ELSE CASE (l_partkey + 3 * rn) % 15
               WHEN 0 THEN concat('The front yard shall be ', CAST(l_partkey % 9 AS STRING), '.5 metres') WHEN 1 THEN concat('Minimum required front or flanking setback: ', CAST(l_partkey % 7 AS STRING), ' metres')
               WHEN 2 THEN concat('Maximum height of ', CAST(l_partkey % 60 AS STRING), ' feet below an angular plane') WHEN 3 THEN 'No building may exceed the maximum required building height specified on Schedule 15'
               WHEN 4 THEN concat('An office use has one parking space for each ', CAST(l_partkey % 900 AS STRING), ' square feet') WHEN 5 THEN concat('A restaurant use in the ', zone, ' zone needs parking accommodation')
               WHEN 6 THEN 'An accessory building may be located in the rear yard' WHEN 7 THEN concat('The maximum size of its footprint is ', CAST(l_partkey % 90 AS STRING), '.0 square metres')
               WHEN 8 THEN concat('Side-yard of a townhouse dwelling use: none, and 3.0 metres elsewhere in ', zone) WHEN 9 THEN concat('lot coverage maximum ', CAST(l_partkey % 60 AS STRING), '%')
               WHEN 10 THEN concat('Population density of ', CAST(l_partkey % 300 AS STRING), ' persons per acre in the South End') WHEN 11 THEN 'Landscaped open space for homes with two or more bedrooms'
               WHEN 12 THEN concat('Lot frontage ', CAST(l_partkey % 50 AS STRING), ' feet') WHEN 13 THEN 'The official street line is on the map' ELSE 'General residential matters' END END AS text
    FROM (SELECT o_custkey, l_orderkey, l_partkey, page_number, CASE l_orderkey % 7 WHEN 0 THEN 'R-1' WHEN 1 THEN 'HR-2' WHEN 2 THEN 'C-2A' WHEN 3 THEN 'ER3' WHEN 4 THEN 'R-2' WHEN 5 THEN 'HR-1' ELSE 'R1' END AS zone,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
          FROM {lineitem} JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS page_number FROM {orders}) AS paged ON l_orderkey = o_orderkey) AS numbered"""

_ZONING_TABLES = """
    SELECT document_id, fragment_id + 500 AS table_id, page_number AS page_start,
           CASE fragment_id % 8
             WHEN 0 THEN concat('Lot Frontage | Lot Area ; ', CAST(reading_order AS STRING), ' feet | 4000 square feet') WHEN 1 THEN 'Side Yard | Lot Coverage ; see map | see map'
             WHEN 2 THEN concat('Size of building | Height ; ', CAST(reading_order AS STRING), ' | vertical angle') WHEN 3 THEN 'Parking lots and parking structures existing | yes'
             WHEN 4 THEN 'Special parking | office use ; 1 space per unit | required to provide' WHEN 5 THEN 'Accessory buildings | deleted'
             WHEN 6 THEN concat('Distance from lot line | rear yard ; ', CAST(reading_order AS STRING), ' metres | south end') ELSE 'Dwelling units | persons per acre ; landscaped open space | 120 square feet' END AS text
    FROM (SELECT document_id, page_number, reading_order, CAST(floor(fragment_id / 1000) AS BIGINT) * 7 + fragment_id % 1000 AS fragment_id FROM {d_zoning} WHERE parent_fragment_id IS NOT NULL) AS lines
    WHERE fragment_id % 3 = 0"""

# Tables are numbered by lots of 1,000 parts, so that their number grows with the data and none grows without end.
_LOTS = """(SELECT *, CAST(CAST(substr(p_brand, 7) AS BIGINT) + 10000 * floor(p_partkey / 1000) AS BIGINT) AS brand, CAST(p_size + 10000 * floor(p_partkey / 1000) AS BIGINT) AS sized FROM {part}) AS lots"""

_CELLS = f"""
    SELECT table_id, CAST(r AS BIGINT) AS row_index, col_index, text FROM (
        SELECT brand AS table_id, row_number() OVER (PARTITION BY brand ORDER BY p_partkey) AS r, 0 AS col_index,
               CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS text FROM {_LOTS}
        UNION ALL
        SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY p_partkey), 1, CAST(p_size AS STRING) FROM {_LOTS}
        UNION ALL
        SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY p_partkey), 2, concat('R-', CAST(p_size % 5 AS STRING)) FROM {_LOTS}
        UNION ALL
        SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY p_partkey), 3, p_name FROM {_LOTS}
        UNION ALL
        SELECT DISTINCT brand, 0, c, h FROM {_LOTS}
        CROSS JOIN (SELECT 0 AS c, 'Type' AS h UNION ALL SELECT 1, 'Size' UNION ALL SELECT 2, 'Zone' UNION ALL SELECT 3, 'Name') AS heads
    ) AS cells"""

_MATRIX = f"""
    SELECT sized AS table_id, r AS row_index, c AS col_index, text FROM (
        SELECT sized, row_number() OVER (PARTITION BY sized ORDER BY p_partkey) AS r, 0 AS c, concat(p_name, ' use') AS text FROM {_LOTS}
        UNION ALL
        SELECT sized, r, z,
               CASE (p_partkey + z) % 5 WHEN 0 THEN '' WHEN 1 THEN 'P' WHEN 2 THEN concat('[', CAST(p_partkey % 9 + 1 AS STRING), ']') WHEN 3 THEN 'C' ELSE '' END
        FROM (SELECT sized, p_partkey, row_number() OVER (PARTITION BY sized ORDER BY p_partkey) AS r FROM {_LOTS}) AS numbered
        CROSS JOIN (SELECT 1 AS z UNION ALL SELECT 2 UNION ALL SELECT 3) AS zs
        UNION ALL
        SELECT DISTINCT sized, CAST(0 AS BIGINT), z, h FROM {_LOTS}
        CROSS JOIN (SELECT 0 AS z, 'Use' AS h UNION ALL SELECT 1, 'DD' UNION ALL SELECT 2, 'CEN-2' UNION ALL SELECT 3, 'HR-1') AS heads
    ) AS m"""

# One table for each size of a part, of five kinds by turns; those of dimensions are cut into tables of four rows.
_NUMBERED = f"""(SELECT p_partkey, p_name, p_size AS kind, r, CASE WHEN sized % 5 = 2 THEN CAST(sized + 100 * floor((r - 1) / 4) AS BIGINT) ELSE sized END AS table_id
                 FROM (SELECT *, row_number() OVER (PARTITION BY sized ORDER BY p_partkey) AS r FROM {_LOTS}) AS parts) AS numbered"""

# Notes to the tables of documents: numbered conditions, two in three of which name a section of their document.
_CONDITIONS = """
    SELECT o_orderkey AS fragment_id, CAST(o_custkey % 50 + 1 + 10000 * floor(o_custkey / 750) AS BIGINT) AS document_id, CAST(o_orderkey % 40 AS STRING) AS citation_label,
           concat('[', CAST(o_orderkey % 13 AS STRING), '] ', CASE o_orderkey % 3 WHEN 0 THEN 'applies to corner lots'
             WHEN 1 THEN concat('subject to section ', CAST((o_orderkey * 7 + 3) % 40 AS STRING))
             ELSE concat('as [', CAST(o_orderkey % 5 AS STRING), '], by Section ', CAST((o_orderkey * 3) % 40 AS STRING), ' and section  ', CAST((o_orderkey + 1) % 40 AS STRING), ' together') END) AS text
    FROM {orders}"""

_TABLES = f"""
    SELECT table_id, CAST(r AS BIGINT) AS row_index, c AS col_index, text FROM (
        SELECT table_id, r, 0 AS c,
               CASE kind % 5 WHEN 0 THEN concat(p_name, ' use') WHEN 1 THEN concat(p_name, '  facility') WHEN 2 THEN concat('R-', CAST(p_partkey % 9 AS STRING))
                 WHEN 3 THEN CASE p_partkey % 3 WHEN 0 THEN 'Minimum side yard for additions' WHEN 1 THEN 'Lot coverage' ELSE 'Other matters' END
                 ELSE concat('Key ', CAST(p_partkey AS STRING)) END AS text
        FROM {_NUMBERED} WHERE kind % 5 < 4 OR r <= 6
        UNION ALL
        SELECT table_id, r, z,
               CASE WHEN r % 11 = 0 AND kind % 5 < 2 THEN concat('HR-', CAST(z AS STRING)) WHEN (p_partkey + z) % 5 = 0 THEN ' '
                 WHEN kind % 5 = 0 THEN CASE (p_partkey + z) % 4 WHEN 0 THEN 'X' WHEN 1 THEN concat('[', CAST(p_partkey % 9 + 1 AS STRING), '] [12]') WHEN 2 THEN 'C' ELSE 'x' END
                 WHEN kind % 5 = 1 THEN concat('1 space per ', CAST(p_partkey % 90 AS STRING), ' m2')
                 WHEN kind % 5 = 2 THEN concat(CAST(p_partkey % 400 AS STRING), ' metres') ELSE concat(CAST(p_partkey % 40 AS STRING), '% [', CAST(z AS STRING), ']') END
        FROM {_NUMBERED} CROSS JOIN (SELECT 1 AS z UNION ALL SELECT 2 UNION ALL SELECT 3) AS zs WHERE kind % 5 < 4 OR (z = 1 AND r <= 6)
        UNION ALL
        SELECT DISTINCT table_id, CAST(0 AS BIGINT), z,
               CASE kind % 5 WHEN 0 THEN zone WHEN 1 THEN CASE z WHEN 0 THEN 'Parking' ELSE zone END
                 WHEN 2 THEN CASE z WHEN 0 THEN 'Zone' WHEN 1 THEN 'Minimum Lot Area' WHEN 2 THEN 'Building Height' ELSE 'Notes' END
                 WHEN 3 THEN CASE z WHEN 0 THEN 'Standard' WHEN 1 THEN 'Rear additions' WHEN 2 THEN 'Interior conversion' ELSE 'All  others' END
                 ELSE CASE z WHEN 0 THEN 'Key' ELSE 'Value' END END
        FROM {_NUMBERED} CROSS JOIN (SELECT 0 AS z, 'Use' AS zone UNION ALL SELECT 1, 'DD' UNION ALL SELECT 2, 'lHR-2' UNION ALL SELECT 3, 'CEN 2') AS heads WHERE kind % 5 < 4 OR z <= 1
    ) AS t"""

DERIVED: dict[str, tuple[str, str]] = {
    "d_blocks": (
        f"SELECT {_BLOCK} FROM (SELECT doc_id AS document_id, i, raw_text FROM {{documents}} LATERAL VIEW posexplode(split(text, '\\n')) AS i, raw_text) WHERE raw_text RLIKE '\\\\S'",
        f"SELECT {_BLOCK} FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS raw_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {{documents}}) WHERE regexp_matches(raw_text, '\\S')",
    ),
    "d_clauses": _same(_CLAUSE),
    # Clauses with definitions of four forms: in quotes, in small letters, over two lines, and plain.
    "d_definitions": _same(
        """SELECT document_id, fragment_id, CASE WHEN fragment_id % 24 <> 13 THEN text WHEN fragment_id % 5 = 0 THEN text WHEN fragment_id % 5 = 1 THEN concat(replace(text, '"', ''), chr(10), 'and whatever stands on it')
                  WHEN fragment_id % 5 = 2 THEN lower(replace(text, '"', '')) ELSE replace(text, '"', '') END AS text FROM {d_clauses}"""
    ),
    "d_fragments": _same(_FRAGMENTS),
    "d_outline": _same(_OUTLINE),
    "d_faulty": _same(_FAULTY),
    "d_bylaws": (_BYLAWS, _BYLAWS.replace("\\n'", "' || chr(10)").replace("|| chr(10),", "|| chr(10),")),
    "d_parts": _same(
        """SELECT document_id, document_id * 1000000 + reading_order AS block_id, page_number AS page,
                  CASE WHEN raw_text LIKE '%|%' THEN 'table_region' WHEN reading_order % 17 = 1 THEN 'footnote' ELSE 'paragraph' END AS block_type,
                  reading_order % 40 = 0 AS is_boilerplate, reading_order % 9 <> 4 AS accounted
           FROM {d_blocks}"""
    ),
    "d_zoning": _same(_ZONING),
    "d_zoning_tables": _same(_ZONING_TABLES),
    "d_standard_calls": _same(
        """SELECT c_custkey AS question_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - c_custkey % 3 + 1 ELSE c_custkey END AS document_id,
                  CASE c_custkey % 8 WHEN 0 THEN 'R-1' WHEN 1 THEN 'HR-2' WHEN 2 THEN 'C-2A' WHEN 3 THEN 'ER-3' WHEN 4 THEN 'R-2' WHEN 5 THEN 'HR-1' WHEN 6 THEN 'CEN-2' END AS zone,
                  CASE c_custkey % 14 WHEN 0 THEN 'front_yard' WHEN 1 THEN 'side_yard' WHEN 2 THEN 'rear_yard' WHEN 3 THEN 'flankage_yard' WHEN 4 THEN 'building_height' WHEN 5 THEN 'lot_frontage' WHEN 6 THEN 'lot_area'
                    WHEN 7 THEN 'lot_coverage' WHEN 8 THEN 'open_space' WHEN 9 THEN 'density' WHEN 10 THEN 'parking' WHEN 11 THEN 'accessory_structure' WHEN 12 THEN 'setback' END AS standard_type,
                  CASE WHEN c_custkey % 14 = 10 THEN CASE c_custkey % 2 WHEN 0 THEN 'Office use' ELSE 'restaurant use' END WHEN c_custkey % 11 = 0 THEN 'office use' END AS use_type,
                  CASE WHEN c_custkey % 5 = 0 THEN 'South End' END AS area_context
           FROM {customer}"""
    ),
    "d_cells": _same(_CELLS),
    "d_matrix": _same(_MATRIX),
    "d_tables": _same(_TABLES),
    "d_conditions": _same(_CONDITIONS),
    "d_questions": _same("SELECT item_id AS question_id, text AS question FROM {benchmark}"),
    "d_phrases": (
        "SELECT doc_id AS question_id, array_join(slice(split(text, ' '), 3, 4), ' ') AS question FROM {documents} WHERE doc_id % 20 = 0 AND text IS NOT NULL",
        "SELECT doc_id AS question_id, array_to_string(string_split(text, ' ')[3:6], ' ') AS question FROM {documents} WHERE doc_id % 20 = 0 AND text IS NOT NULL",
    ),
    "d_inquiries": _same(
        """SELECT c_custkey AS question_id,
                  CASE c_custkey % 20
                    WHEN 0 THEN concat('What is the maximum building height in the R', CAST(c_custkey % 7 AS STRING), 'A zone?')
                    WHEN 1 THEN concat('Is a temporary use permitted under subsection ', CAST(c_custkey % 50 AS STRING), '.2(a) in R-1?')
                    WHEN 2 THEN 'What is the sideyard setback the R2 zone ?'
                    WHEN 3 THEN concat('Can I operate a pet  grooming use in lHR-1 near parcel ', CAST(c_custkey AS STRING))
                    WHEN 4 THEN 'How many stories are allowed for an office use in the CEN 2 zone, except on corners?'
                    WHEN 5 THEN 'Is a backyard suite allowed behind a single-unit dwelling in the South End?'
                    WHEN 6 THEN concat('Define landscaped open space and see Section ', CAST(c_custkey % 90 AS STRING))
                    WHEN 7 THEN 'What is a daycare?'
                    WHEN 8 THEN concat('How many parking stalls does a restaurant use require in C-2A under Schedule B', CAST(c_custkey % 9 AS STRING), '?')
                    WHEN 9 THEN 'Can a townhouse have a rear addition in ER-3 if conditions [4] and [12] apply?'
                    WHEN 10 THEN 'What population density, in persons per acre, is the limit?'
                    WHEN 11 THEN concat('See clause ', CAST(c_custkey % 40 AS STRING), '-', CAST(c_custkey % 3 AS STRING), ' subject to the table')
                    WHEN 12 THEN concat('Minimum lot area and lot frontage, ', CAST(c_custkey % 700 AS STRING), ' m2, where no zone is named')
                    WHEN 13 THEN 'Does the accessory structure need a permit? An accessory building  too'
                    WHEN 14 THEN 'What condition applies to a retail use or a very large motor vehicle repair use within DD?'
                    WHEN 15 THEN 'I want to build a shipping container home; flankage yard in CH1'
                    WHEN 16 THEN 'Interior conversion of an apartment house: dwelling units and day care, schedule A'
                    WHEN 17 THEN concat('Who owns lot ', CAST(c_custkey AS STRING), ', pid: 0', CAST(c_custkey + 1234567 AS STRING), ', at ', CAST(c_custkey AS STRING), ' o''brien hill ',
                      CASE c_custkey % 7 WHEN 0 THEN 'Blvd' WHEN 1 THEN 'way' WHEN 2 THEN 'PLACE' WHEN 3 THEN 'Hwy.' WHEN 4 THEN 'Parkway' WHEN 5 THEN 'Terr' ELSE 'Cres' END, ' or 12 Long Pond Ct?')
                    WHEN 18 THEN 'maximum coverage of the yard in the UC-1 ZONE; parking at the rear'
                    ELSE 'what is' END AS question
           FROM {customer}"""
    ),
    # The template does not hang on the id's remainder by 20, which picks those that are asked.
    "d_evidence_questions": _same(
        """SELECT c_custkey AS question_id,
                  CASE CAST(floor(c_custkey / 20) AS BIGINT) % 9
                    WHEN 0 THEN concat('What is the minimum lot area in the R-', CAST(c_custkey % 9 AS STRING), ' zone?')
                    WHEN 1 THEN concat('Is a ', p_name, ' use permitted in the HR-2 zone?')
                    WHEN 2 THEN concat('How many parking spaces does a ', p_name, ' facility require in CEN-2?')
                    WHEN 3 THEN concat('What is the building height in the R-', CAST(c_custkey % 7 AS STRING), ' zone under section ', CAST(c_custkey % 300 AS STRING), '?')
                    WHEN 4 THEN concat('Define Lot ', CAST(c_custkey % 40 AS STRING), ' and its frontage')
                    WHEN 5 THEN 'What is the lot coverage for rear additions?'
                    WHEN 6 THEN concat('Is a ', p_name, ' use permitted in DD if condition [', CAST(c_custkey % 9 + 1 AS STRING), '] applies?')
                    WHEN 7 THEN concat('What does section ', CAST(c_custkey % 300 AS STRING), '.', CAST(c_custkey % 7 AS STRING), ' say about schedule b of this By-law?')
                    ELSE concat('Every owner near ', CAST(c_custkey % 40 AS STRING), ' rue de l''eglise lane: what is the side yard for an interior conversion?') END AS question
           FROM {customer} JOIN {part} ON p_partkey = c_custkey"""
    ),
    "d_requests": _same(
        """SELECT c_custkey AS question_id,
                  CASE c_custkey % 8
                    WHEN 0 THEN concat('What is the maximum height in the HR-1 zone for lot ', CAST(c_custkey AS STRING), '?')
                    WHEN 1 THEN concat('Can a restaurant use locate at ', CAST(c_custkey % 900 + 1 AS STRING), ' Barrington Street in DD?')
                    WHEN 2 THEN concat('Define lot coverage and what is the meaning of PID ', CAST(10000000 + c_custkey AS STRING))
                    WHEN 3 THEN concat('How many parking spaces are required under section ', CAST(c_custkey % 90 AS STRING), '.2?')
                    WHEN 4 THEN 'What is the minimum lot area and lot frontage in CEN-2?'
                    WHEN 5 THEN 'Which uses are permitted in the COR zone?'
                    WHEN 6 THEN concat('Are storeys limited on ', CAST(c_custkey % 300 + 1 AS STRING), ' Spring Garden Road')
                    ELSE 'What does Schedule 15 say about signs?' END AS question
           FROM {customer}"""
    ),
    "d_edges": _same("SELECT DISTINCT l_suppkey AS source_id, 1000000 + l_partkey AS target_id, CASE WHEN l_linestatus = 'O' THEN 'references' ELSE 'conditioned_by' END AS edge_type FROM {lineitem}"),
    "d_parcels": _same(
        """SELECT c_custkey AS feature_id, c_mktsegment AS dataset, c_acctbal AS max_height, c_nationkey AS storeys,
                  -63.6 + (c_custkey % 40) * 0.001 AS x0, 44.6 + CAST(floor(c_custkey / 40) AS BIGINT) * 0.001 AS y0,
                  -63.6 + (c_custkey % 40) * 0.001 + 0.001 AS x1, 44.6 + CAST(floor(c_custkey / 40) AS BIGINT) * 0.001 + 0.001 AS y1
           FROM {customer}"""
    ),
    "d_streets": _same(
        """SELECT s_suppkey AS line_id, CASE WHEN s_suppkey % 2 = 0 THEN -63.6 + (s_suppkey % 37) * 0.0003 ELSE -63.6 + (s_suppkey % 40) * 0.001 END AS x0,
                  CASE WHEN s_suppkey % 2 = 0 THEN 44.6 + s_suppkey * 0.0001 ELSE 44.6 + (s_suppkey % 11) * 0.0007 END AS y0,
                  CASE WHEN s_suppkey % 2 = 0 THEN -63.6 + (s_suppkey % 37) * 0.0003 + 0.0052 ELSE -63.6 + (s_suppkey % 40) * 0.001 END AS x1,
                  CASE WHEN s_suppkey % 2 = 0 THEN 44.6 + s_suppkey * 0.0001 ELSE 44.6 + (s_suppkey % 11) * 0.0007 + 0.0041 END AS y1
           FROM {supplier}"""
    ),
    "d_addresses": _same(
        """SELECT event_id AS address_id, user_id AS civic_number,
                  concat(CASE event_id % 6 WHEN 0 THEN 'Barrington' WHEN 1 THEN 'Spring Garden' WHEN 2 THEN 'Quinpool' WHEN 3 THEN 'Agricola' WHEN 4 THEN 'South Park' ELSE 'Gottingen' END,
                         CASE event_id % 5 WHEN 0 THEN ' Street' WHEN 1 THEN ' st.' WHEN 2 THEN '  Avenue' WHEN 3 THEN ' ROAD' ELSE ' Cres.' END) AS street,
                  -63.6 + (event_id * 37 % 4100) * 0.00001 AS x, 44.6 + (event_id * 53 % 4100) * 0.00001 AS y
           FROM {events}"""
    ),
    "d_credits": _same(
        """SELECT o_orderkey AS credit_id, o_custkey % 150 AS user_id,
                  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'quick' WHEN '2' THEN 'quick' WHEN '3' THEN 'standard' ELSE 'complex' END AS tier,
                  CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'P' THEN 'reserved' ELSE 'consumed' END AS state,
                  CASE o_orderkey % 4 WHEN 0 THEN 'starter' ELSE 'purchase' END AS source,
                  o_orderdate AS purchased_at, o_orderkey % 500 AS case_id,
                  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 700 END AS session_id
           FROM {orders}"""
    ),
    "d_cases": _same(
        """SELECT o_orderkey % 500 AS case_id, min(o_custkey) % 150 AS user_id, concat('key-', CAST(min(o_custkey) % 60 AS STRING)) AS match_key,
                  min(o_orderdate) AS opened_at, max(o_orderdate) AS last_activity,
                  CASE WHEN min(o_custkey) % 2 = 0 THEN 'open' ELSE 'closed' END AS status,
                  CASE min(o_custkey) % 3 WHEN 0 THEN 'quick' WHEN 1 THEN 'standard' ELSE 'complex' END AS tier
           FROM {orders} GROUP BY o_orderkey % 500"""
    ),
    "d_usage": _same(
        """SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts,
                  CASE event_type WHEN 'click' THEN 'llm_call' WHEN 'error' THEN 'rate_limit_exceeded' WHEN 'view' THEN 'upgrade_offered' WHEN 'purchase' THEN 'upgrade_accepted' ELSE event_type END AS event_type,
                  CAST(floor(value * 100) AS BIGINT) AS tokens, event_id % 400 AS session_id
           FROM {events}"""
    ),
    "d_turns": _same(
        """SELECT conv_id AS session_id, turn, role, text, role = 'assistant' AND turn % 3 = 1 AS has_tool_use,
                  CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN concat('call-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) END AS tool_id,
                  CASE turn % 4 WHEN 1 THEN 'search' ELSE 'lookup' END AS tool_name
           FROM {conversations}"""
    ),
    "d_candidates": _same(
        """SELECT l_partkey AS question_id, 5000000000000 + l_orderkey * 1000 + l_linenumber AS source_fragment_id,
                  CASE l_suppkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'vector' WHEN 2 THEN 'table' ELSE 'semantic' END AS retrieval_channel,
                  l_discount * 10 AS base_score, l_suppkey % 5 AS priority_class,
                  concat('Subject to section ', CAST(l_suppkey AS STRING), ' height storey definition ', CAST(l_partkey AS STRING), CASE l_suppkey % 5 WHEN 0 THEN ' minimum lot area' WHEN 1 THEN ' parking in R2' ELSE '' END,
                         repeat(' lot', CAST(l_quantity AS INT))) AS text,
                  CASE WHEN l_partkey % 11 = 0 THEN 'semantic_section_reference' END AS expansion
           FROM {lineitem}"""
    ),
}
