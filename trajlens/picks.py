"""What a user says about a dataset's arrays: which are state and action, which dimensions are arms, grippers and hands."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

ROLES = ("arm", "gripper", "hand")


def slug(name: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


@dataclass(frozen=True)
class Group:
    """Dimensions of one part of the robot. arm: the arm that a gripper belongs to."""

    name: str
    role: str
    dims: tuple[int, ...]
    arm: str | None = None

    @property
    def signal(self) -> str:
        return f"{self.role}_{slug(self.name)}"


@dataclass(frozen=True)
class Picks:
    """joint_positions: whether actions are joint positions in the state's space; open_high: whether an open gripper has large values; None: not said."""

    action: str | None = None
    state: str | None = None
    joint_positions: bool | None = None
    open_high: bool | None = None
    groups: tuple[Group, ...] = ()
    cameras: tuple[str, ...] = field(default_factory=tuple)

    def of(self, *roles: str) -> list[Group]:
        return [g for g in self.groups if g.role in roles]

    def arm_dims(self) -> list[int]:
        """Dimensions of all arms, without hands and grippers."""
        return sorted({d for g in self.of("arm") for d in g.dims})

    def arm_of(self, gripper: Group) -> Group | None:
        """The arm that the gripper names, else the only one."""
        arms = self.of("arm")
        named = [a for a in arms if gripper.arm is not None and slug(a.name) == slug(gripper.arm)]
        return named[0] if named else arms[0] if len(arms) == 1 and gripper.arm is None else None

    def assumptions(self) -> dict[str, object]:
        """What has been said of the data, as a run record keeps it; what nobody said is left out."""
        said = {"joint_positions": self.joint_positions, "open_high": self.open_high}
        return {k: v for k, v in said.items() if v is not None} | {"cameras": list(self.cameras)}

    def joint_space(self, action_dim: int, state_dim: int) -> bool:
        return bool(self.joint_positions) and action_dim == state_dim

    def for_source(self, action_dim: int | None) -> Picks:
        """Without the groups that an action of this size doesn't have."""
        return replace(self, groups=tuple(g for g in self.groups if g.role in ROLES and g.dims and action_dim is not None and max(g.dims) < action_dim))

    def readiness(self, cameras: bool = False) -> list[tuple[str, str | None]]:
        """Metric families and what must still be picked for each, None where it is ready."""
        arms, grippers, hands = self.of("arm"), self.of("gripper"), self.of("hand")
        action = None if self.action else "pick the action array"
        space = {None: "say whether the action is joint positions", False: "only for joint positions", True: None}[self.joint_positions]
        opened = None if self.open_high is not None else "say which way the gripper opens"
        found = [
            ("smoothness", action or (None if arms or hands else "pick arm joints")),
            ("time", action or (None if arms else "pick arm joints")),
            ("tracking", space if self.action and self.state else "pick the state and action arrays"),
            ("gripper", opened if grippers else "pick gripper joints"),
        ]
        return found + ([("camera", None if self.cameras else "pick a camera")] if cameras else []) + [("integrity", None), ("language", None)]


def assemble(dual: bool, dims: dict[str, list[int]]) -> tuple[Group, ...]:
    """Groups from the dimensions put in each field ("arm", or "left_arm" for two arms); a dimension counts in its first field only."""
    groups, taken = [], set()
    for side in ("left", "right") if dual else ("all",):
        for role in ROLES:
            own = [d for d in sorted(set(dims.get(f"{side}_{role}" if dual else role) or [])) if d not in taken]
            taken |= set(own)
            if own:
                has_arm = role == "gripper" and any(g.role == "arm" and g.name == side for g in groups)
                groups.append(Group(side, role, tuple(own), side if has_arm else None))
    return tuple(groups)


def fields_of(dual: bool, groups: tuple[Group, ...]) -> dict[str, list[int]]:
    """The inverse of assemble: the dimensions of each field, empty ones too."""
    sides = ("left", "right") if dual else ("all",)
    found = {(g.name, g.role): list(g.dims) for g in groups}
    return {(f"{side}_{role}" if dual else role): found.get((side, role), []) for side in sides for role in ROLES}


def labelled(dims: list[int] | tuple[int, ...], of: list[str]) -> list[str]:
    """The labels of these dimensions, in their order; dimensions beyond the array have none."""
    return [of[d] for d in sorted(set(dims)) if d < len(of)]


def dims_labelled(chosen: list[str], of: list[str]) -> list[int]:
    """The dimensions that carry these labels; labels that the array lacks are passed by."""
    place = {name: i for i, name in enumerate(of)}
    return sorted({place[x] for x in chosen if x in place})


#: What a metric needs of the picks, family by family and where it differs by name.
_NEEDS: dict[str, tuple[str, ...]] = {
    "motion": ("action", "mover"),
    "sparc_phase": ("action", "arm", "gripper"),
    "time": ("action", "arm"),
    "length_z": (),
    "tracking": ("action", "state", "space", "arm"),
    "gripper": ("action", "gripper"),
    "missed_grasp_frac": ("action", "state", "space", "arm", "gripper", "opening"),
    "recovery_count": ("action", "arm", "gripper", "opening"),
    "consistency": ("action", "state"),
    "camera": ("camera",),
    "frozen_frac": ("camera", "state", "arm"),
    "video_action_lag_ms": ("camera", "action", "arm"),
}
_SAY = {"action": "no action array is picked", "state": "no state array is picked", "mover": "no arm or hand joints are picked", "arm": "no arm joints are picked", "gripper": "no gripper joints are picked", "opening": "which way the gripper opens is not said", "camera": "no camera is picked"}


def why_off(picks: Picks, metrics: dict[str, str]) -> dict[str, str]:
    """Of metrics (name to family), those that the picks leave without values, each with the first thing that is missing."""
    have = {"action": bool(picks.action), "state": bool(picks.state), "mover": bool(picks.of("arm", "hand")), "arm": bool(picks.of("arm")), "gripper": bool(picks.of("gripper")), "opening": picks.open_high is not None, "camera": bool(picks.cameras), "space": picks.joint_positions is True}
    say = _SAY | {"space": "it is not said whether actions are joint positions" if picks.joint_positions is None else "actions are not joint positions"}
    lacks = {name: [n for n in _NEEDS.get(name, _NEEDS.get(family, ())) if not have[n]] for name, family in metrics.items()}
    return {name: say[missing[0]] for name, missing in lacks.items() if missing}


def labels(names: list[str], feature: str) -> list[str]:
    """One label a dimension: its name, with its place where the name repeats."""
    return [n if names.count(n) == 1 else f"{n} ({feature}[{i}])" for i, n in enumerate(names)]


def infer(features: dict[str, int], wanted: dict[str, tuple[str, str]]) -> tuple[dict[str, str | None], list[str]]:
    """Feature by exact name, else by the only match of a pattern; None with a note where there is none or are several.

    wanted: what to find -> (name, pattern).
    """
    found, notes = {}, []
    for what, (name, pattern) in wanted.items():
        hits = [name] if name in features else [f for f in features if re.search(pattern, f)]
        found[what] = hits[0] if len(hits) == 1 else None
        if len(hits) != 1:
            notes.append(f"{what}: {'no feature' if not hits else 'several features'} fit")
    return found, notes


def picked(features: dict[str, int], picks: Picks) -> tuple[Picks, list[str]]:
    """picks without the arrays that a source lacks, and a note for each."""
    gone = {k: getattr(picks, k) for k in ("action", "state") if getattr(picks, k) and getattr(picks, k) not in features}
    kept = replace(picks, **dict.fromkeys(gone)).for_source(features.get(picks.action) if picks.action else None)
    return kept, [f"{k}: the source has no {v}" for k, v in gone.items()]
