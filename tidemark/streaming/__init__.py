"""Structured Streaming counterparts of batch operators, for ticks that keep arriving.

Each operator takes and returns a streaming DataFrame with bounded state. Rows up to ``delay`` behind the newest row seen
always count, so results do not depend on how the input was cut into batches or on the order inside them. A later row
is dropped once the watermark of an earlier batch has passed it. What an operator has emitted once is final (append
mode). Times at or before 1970-01-01 count as late: that is where the watermark of a new stream stands.
"""
