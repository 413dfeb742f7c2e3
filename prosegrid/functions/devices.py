"""Device names of model-backed analyzers."""

from __future__ import annotations


def gpu_available() -> bool:
    try:
        import torch
    except ImportError:
        return False
    return bool(torch.cuda.is_available())


def device_id(device: str) -> int:
    """-1 for the CPU, a number for ``cuda:N``; ``auto`` takes the first GPU if there is one."""
    kind, _, number = device.partition(":")
    if device == "cpu":
        return -1
    if device == "auto":
        return 0 if gpu_available() else -1
    if kind == "cuda" and number.isdecimal():
        return int(number)
    raise ValueError(f"{device!r} is not cpu, auto or cuda:N")
