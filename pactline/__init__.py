"""Contract enforcement for Spark DataFrames: declare a contract, validate rows, repair what can be trusted."""

from .contract import MISSING, VERSION, Config, Constraint, Contract, Field, Member, contract_of_schema, find_field, parse_contract
from .functions.trust import Evidence, Policy
from .operators.checks import Violation
from .operators.guard import Guard
from .operators.repair import Attempt, Operation, Result, Strategy, repair
from .operators.telemetry import Silent, Telemetry, log_lines
from .sources.models import ModelCheck, guard_of_model

__version__ = VERSION
__all__ = [
    "MISSING", "Attempt", "Config", "Constraint", "Contract", "Evidence", "Field", "Guard", "Member", "ModelCheck", "Operation", "Policy", "Result", "Silent", "Strategy", "Telemetry", "Violation",
    "contract_of_schema", "find_field", "guard_of_model", "log_lines", "parse_contract", "repair",
]
