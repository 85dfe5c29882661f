"""What a finding says, in English and Vietnamese."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each rule the message in both languages; {} is the claim.
MESSAGES: dict[str, tuple[str, str]] = {
    "path-moved": ("{} was there when this line was written and has gone since", "{} còn đó khi dòng này được viết, nay đã mất"),
    "path-removed-now": ("{} is in the last commit but no more in the tree", "{} có trong commit cuối nhưng không còn trong cây thư mục"),
    "path-gone": ("{} was part of the tree at another time", "{} từng có trong cây thư mục vào lúc khác"),
    "path-typo": ("{} is not there; another name is close to it", "không có {}; có tên khác gần giống"),
    "path-missing": ("{} is not in the tree", "{} không có trong cây thư mục"),
    "link-broken": ("the link {} leads nowhere", "liên kết {} không dẫn tới đâu"),
    "link-case": ("{} is spelled with other capitals", "{} viết khác chữ hoa, chữ thường"),
    "link-unverified": ("only the built site can tell where {} leads", "chỉ trang đã dựng mới biết {} dẫn tới đâu"),
    "foreign-links": ("most links of this page never led anywhere here: {}", "đa số liên kết của trang này chưa từng dẫn tới đâu: {}"),
    "anchor-missing": ("no heading answers to {}", "không có tiêu đề nào ứng với {}"),
    "anchor-unverified": ("{} cannot be told from the source", "không thể xác minh {} từ mã nguồn"),
    "command-missing": ("the command runs {}, which is not there", "lệnh chạy {}, nhưng tệp này không có"),
    "flag-removed": ("the option {} has been removed", "tùy chọn {} đã bị bỏ"),
    "flag-missing": ("no code knows the option {}", "không có mã nào biết tùy chọn {}"),
    "subcommand-missing": ("the program has no subcommand {}", "chương trình không có lệnh con {}"),
    "symbol-gone": ("{} is no more in the code", "{} không còn trong mã"),
    "symbol-removed-now": ("{} is in the last commit but no more in the code", "{} có trong commit cuối nhưng không còn trong mã"),
    "npm-script-missing": ("package.json has no script {}", "package.json không có script {}"),
    "make-target-missing": ("there is no target {}", "không có đích {}"),
    "decision-unknown": ("the log has no decision {}", "nhật ký không có quyết định {}"),
    "decision-superseded": ("decision {} has been replaced", "quyết định {} đã bị thay thế"),
    "decision-amended": ("decision {} has been changed by a later one", "quyết định {} đã được sửa bởi quyết định sau"),
    "version-mismatch": ("the manifest states another version than {}", "tệp khai báo ghi phiên bản khác {}"),
    "dep-mismatch": ("the manifest pins {} otherwise", "tệp khai báo ghim {} khác"),
    "copies-diverged": ("a newer copy of this line has other numbers: {}", "một bản sao mới hơn của dòng này có số khác: {}"),
    "table-shape": ("the row has another number of cells than the header: {}", "hàng có số ô khác tiêu đề: {}"),
    "table-orphan": ("rows cut off from their table: {}", "các hàng bị tách khỏi bảng: {}"),
    "rule-violation": ("a rule of the documents forbids {}", "quy tắc trong tài liệu cấm {}"),
    "rule-invalid": ("the rule {} cannot be read", "không đọc được quy tắc {}"),
    "stale-risk": ("code that this page refers to is newer: {}", "mã mà trang này nhắc tới mới hơn: {}"),
}


def message(rule: Column, claim: Column, lang: str = "en") -> Column:
    """The message of a rule about a claim; rules without one say their name."""
    at = 1 if lang.lower().startswith("vi") else 0
    texts = F.create_map(*(F.lit(x) for name, both in MESSAGES.items() for x in (name, both[at])))
    return F.coalesce(F.replace(F.get(F.array(texts[rule]), F.lit(0)), F.lit("{}"), claim), F.concat(rule, F.lit(": "), claim))


#: What is said of a thing that a change took away: {} is the thing, {0} the file, {1} its new name.
LOST: dict[str, tuple[str, str]] = {
    "file-deleted": ("`{}` was deleted", "`{}` đã bị xóa"),
    "file-renamed": ("`{}` was renamed to `{1}`", "`{}` đã đổi thành `{1}`"),
    "flag": ("the option `{}` was removed from `{0}` and no code has it any more", "tùy chọn `{}` vừa bị bỏ khỏi `{0}` và không còn trong mã nào"),
    "symbol": ("the name `{}` was removed from `{0}` and no code has it any more", "tên `{}` vừa bị bỏ khỏi `{0}` và không còn trong mã nào"),
}


def lost(kind: Column, term: Column, file: Column, note: Column, lang: str = "en") -> Column:
    """The message of a term that a change took away."""
    at = 1 if lang.lower().startswith("vi") else 0
    out = F.create_map(*(F.lit(x) for name, both in LOST.items() for x in (name, both[at])))[kind]
    for mark, value in (("{0}", file), ("{1}", note), ("{}", term)):
        out = F.replace(out, F.lit(mark), value)
    return out
