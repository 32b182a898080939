"""Settings of a cull."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CullConfig:
    """Fixed default values: gap in seconds, hash bits, eye aspect ratio, face confidence, overlap of boxes."""

    burst_threshold_secs: float = 3.0
    phash_similarity_threshold: int = 14
    blink_ear_threshold: float = 0.21
    face_detection_confidence: float = 0.5
    nms_iou_threshold: float = 0.45

    def __post_init__(self):
        if self.burst_threshold_secs < 0 or not 0 <= self.phash_similarity_threshold <= 64:
            raise ValueError(f"out of range: {self}")
        for value in (self.blink_ear_threshold, self.face_detection_confidence, self.nms_iou_threshold):
            if not 0 <= value <= 1:
                raise ValueError(f"out of range: {self}")
