"""Labels the application's reports print."""

UNREGISTERED = "미등록"
TOTAL = "합계"
SUBTOTAL = "소계"
ALL_DEPARTMENTS = "전체"
NO_GRADE = "등급 미산정"
NOT_DECIDED = "미정"
UNKNOWN = "알수없음"
OTHER = "기타"
TOP_OF_TREE = "(최상위)"
UNCATEGORISED = "미분류"
NO_DESCRIPTION = "설명 없음"
DELETED_MARK = "[삭제] "
DELETED_NOTE = " 삭제 처리"
CANCELLED_MARK = "[취소] "
NO_REASON = "사유 미입력"
CREDIT_LIMIT = "신용한도: "
GRADE_PURCHASES = "총 구매: "

CUSTOMER_TYPE = ["P", "개인", "B", "기업"]
CUSTOMER_TYPE_LONG = ["P", "개인고객", "B", "기업고객"]
ORDER_STATUS = ["PENDING", "대기", "CONFIRMED", "확인", "SHIPPED", "배송중", "DELIVERED", "완료", "CANCELLED", "취소"]
PRODUCT_STATUS = [1, "판매중", 0, "판매중지"]
CATEGORY = ["ELEC", "전자제품", "FOOD", "식품", "CLOTH", "의류", "BOOK", "도서"]
SALES_GRADES = ["A등급", "B등급", "C등급", "D등급"]
CUSTOMER_GRADES = [(10_000_000, "VIP"), (5_000_000, "GOLD"), (1_000_000, "SILVER")]
LOWEST_GRADE = "BRONZE"

OPEN_STATUSES = ["PENDING", "CONFIRMED", "SHIPPED"]
CANCELLABLE_STATUSES = ["PENDING", "CONFIRMED"]
