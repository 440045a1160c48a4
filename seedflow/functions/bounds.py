"""Sample-size bounds of influence maximisation, from the published analyses (IMM, OPIM-C, TIM+); plain driver arithmetic."""

from __future__ import annotations

import math

APPROX = 1 - 1 / math.e


def log_binomial(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def imm_theta_prime(x: int, eps_prime: float, l: float, k: int, n: int) -> int:
    """Sets that guess x of IMM's estimation needs."""
    k = min(k, n // 2)
    work = (2 + 2 / 3 * eps_prime) * (l * math.log(n) + log_binomial(n, k) + math.log(math.log2(n)))
    return int(work * 2.0**x / eps_prime**2)


def imm_inverse_theta_prime(theta: int, eps_prime: float, l: float, k: int, n: int) -> float:
    """The guess x for which ``theta`` sets are enough; for resuming from stored sets."""
    k = min(k, n // 2)
    work = (2 + 2 / 3 * eps_prime) * (l * math.log(n) + log_binomial(n, k) + math.log(math.log2(n)))
    return math.log2(theta * eps_prime**2 / work)


def imm_theta(eps: float, l: float, k: int, lower_bound: float, n: int) -> int:
    if lower_bound == 0:
        return 0
    k = min(k, n // 2)
    alpha = math.sqrt(l * math.log(n) + math.log(2))
    beta = math.sqrt(APPROX * (log_binomial(n, k) + l * math.log(n) + math.log(2)))
    return int(2 * n * (APPROX * alpha + beta) ** 2 / eps**2 / lower_bound)


def opim_limits(eps: float, delta: float, k: int, n: int) -> tuple[int, int]:
    """First and largest number of sets of OPIM-C."""
    tail = math.log(6 / delta)
    half = 2 * (APPROX * math.sqrt(tail) + math.sqrt(APPROX * (log_binomial(n, k) + tail))) ** 2
    return math.ceil(half), math.ceil(n * half / (eps**2 * k))


def opim_lower(n: int, theta: int, covered: float, delta: float) -> float:
    a = math.log(1 / delta)
    return n / theta * ((math.sqrt(covered + 2 * a / 9) - math.sqrt(a / 2)) ** 2 - a / 18)


def opim_upper(n: int, theta: int, covered: float, delta: float) -> float:
    a = math.log(1 / delta) / 2
    return n / theta * (math.sqrt(covered / APPROX + a) + math.sqrt(a)) ** 2


def tim_kpt_samples(i: int, n: int) -> int:
    return int((6 * math.log(n) + 6 * math.log(math.log2(n))) * 2**i)


def tim_refine(eps: float, k: int, n: int, kpt: float) -> tuple[float, int]:
    """TIM+'s epsilon and number of sets for refining the estimate kpt."""
    e = 5 * (eps**2 / (k + 1)) ** (1 / 3)
    return e, math.ceil((2 + e) * n * math.log(n) / (e**2 * kpt))


def tim_theta(eps: float, k: int, n: int, kpt: float) -> int:
    return math.ceil((8 + 2 * eps) * n * (math.log(n) + log_binomial(n, k) + math.log(2)) / eps**2 / kpt)
