"""Sheets for people. A report is bounded, so its rows are streamed to the driver and written there."""
