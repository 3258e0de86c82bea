"""Streaming.

The modelled toolbox has no streaming source, watermark or state, so this
package adds none.  The column functions and stateless projections run on a
streaming DataFrame as they are (`tests/test_streaming.py`).
"""
