"""Rule detectors: packet rows to alert rows.

Each detector is a profile (one aggregate per window, source or service) and a
list of rules evaluated side by side on every profile row, so adding a rule
adds no scan and no shuffle.
"""
