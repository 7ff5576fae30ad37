"""Audits of whole records: unions of checks over the records' nested tables, as violations (entity_id, rule_id, severity, path, detail)."""
