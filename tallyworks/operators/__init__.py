"""Relational operators over invoices, rules, reports and selections."""
