"""Profiles, hash domains and sketch specifications."""

from __future__ import annotations

from dataclasses import dataclass, fields

from tallyloom.errors import IncompatibleMergeError, PrecisionMismatchError, UnregisteredDomainError, UnsupportedAlgorithmError, UnsupportedProfileError

HASH_ALGORITHM = "hmac_sha256_64"
#: The registered hash domains.
DOMAINS = ("prompt:v1", "user:v1", "tool:v1", "retrieval-doc:v1", "session:v1", "mcp-session:v1", "mcp-method:v1", "tool-error:v1")

# The shape of each profile.
HLL_SHAPES = {"micro": (12, 16), "small": (14, 18), "default": (15, 20)}
HEAVY_SHAPES = {"micro": 256, "small": 512, "default": 1024}
BLOOM_SHAPES = {"micro": (10_000, 0.001, 143_776, 10), "small": (100_000, 0.001, 1_437_759, 10), "default": (1_000_000, 0.0001, 19_170_117, 13)}
MINHASH_SHAPES = {"micro": 64, "small": 128, "default": 128, "k256": 256}
#: Up to these linear counts a dense sketch answers by linear counting.
LINEAR_LIMITS = {12: 3100, 14: 11500, 15: 20000}


def domains() -> list[str]:
    return list(DOMAINS)


def is_registered_domain(domain: str) -> bool:
    return domain in DOMAINS


def _shape(shapes: dict, profile: str):
    if profile not in shapes:
        raise UnsupportedProfileError(f"no profile {profile!r}; there are {', '.join(shapes)}")
    return shapes[profile]


@dataclass(frozen=True)
class Spec:
    """What two sketches must share to be merged or compared."""

    profile: str = "small"
    domain: str = "prompt:v1"
    algorithm: str = HASH_ALGORITHM

    def __post_init__(self) -> None:
        self.shape  # noqa: B018  raises if there is no such profile
        if not is_registered_domain(self.domain):
            raise UnregisteredDomainError(f"no registered domain {self.domain!r}")
        if self.algorithm != HASH_ALGORITHM:
            raise UnsupportedAlgorithmError(f"no support for {self.algorithm!r}")

    @property
    def shape(self):
        raise NotImplementedError

    def require_same(self, other: Spec) -> None:
        if type(self) is not type(other):
            raise IncompatibleMergeError(f"{type(self).__name__} and {type(other).__name__}")
        for f in fields(self):
            if getattr(self, f.name) != getattr(other, f.name):
                raise IncompatibleMergeError(f"{f.name}: {getattr(self, f.name)!r} and {getattr(other, f.name)!r}")


class HllSpec(Spec):
    @property
    def shape(self) -> tuple[int, int]:
        return _shape(HLL_SHAPES, self.profile)

    @property
    def p(self) -> int:
        return self.shape[0]

    @property
    def sp(self) -> int:
        return self.shape[1]

    @property
    def promotion(self) -> int:
        """A sketch with more sparse registers than this is dense."""
        return 1 << self.p - 4

    @property
    def dense_bytes(self) -> int:
        return 1 << self.p

    def require_same(self, other: Spec) -> None:
        if isinstance(other, HllSpec) and self.shape != other.shape:
            raise PrecisionMismatchError(f"precisions {self.shape} and {other.shape}")
        super().require_same(other)


class HeavySpec(Spec):
    @property
    def shape(self) -> int:
        return _shape(HEAVY_SHAPES, self.profile)

    @property
    def map_size(self) -> int:
        return self.shape


class BloomSpec(Spec):
    @property
    def shape(self) -> tuple[int, float, int, int]:
        return _shape(BLOOM_SHAPES, self.profile)

    @property
    def rated_insertions(self) -> int:
        return self.shape[0]

    @property
    def target_fpr(self) -> float:
        return self.shape[1]

    @property
    def bits(self) -> int:
        return self.shape[2]

    @property
    def hashes(self) -> int:
        return self.shape[3]


class MinHashSpec(Spec):
    @property
    def shape(self) -> int:
        return _shape(MINHASH_SHAPES, self.profile)

    @property
    def k(self) -> int:
        return self.shape


#: Names of the kinds, as SQL and manifests use them.
KIND_NAMES = {HllSpec: "hll", HeavySpec: "heavy", BloomSpec: "bloom", MinHashSpec: "minhash"}
KINDS = {name: kind for kind, name in KIND_NAMES.items()}
