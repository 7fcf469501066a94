"""Lines too far apart to match aren't sampled for their overlap."""

import numpy as np

from waymark.operators import matching


def test_far_lines_are_not_sampled(monkeypatch):
    asked = []
    to_line = matching.to_line
    monkeypatch.setattr(matching, "to_line", lambda points, line: asked.append(len(points)) or to_line(points, line))
    line, way = np.array([[3.8, 43.6], [3.81, 43.6]]), np.array([[3.8, 43.6], [3.805, 43.6]])
    far, share = matching.closeness(line, way, limit=30.0)
    assert far > 300 and share == 0.0 and max(asked) == 2
    assert matching.closeness(line, way)[1] > 0.5
